"""Fill-in-the-middle transformation by secondary sort.

A document is cut into prefix, middle and suffix and written in the order its
form asks for. No task assembles a text to do so: the map side emits pieces of
at most ``CHUNK`` code points under (document, output position),
``repartitionAndSortWithinPartitions`` brings each document's pieces together
in output order, and a reader streams them into incremental digests. To restore
a text its pieces are sorted once more, by the place they had before the cut;
where a piece belongs is read from the markers of the output alone.

Pieces travel compressed, one shuffle in all. A reader holds the compressed
pieces of one document at most. Documents are spread by their row number, so no
key owns a task, and the number of tasks grows with the bytes of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from voxloom.llm.common import worker_cache

# Code points of one piece.
CHUNK = 1 << 15
# Bytes of text of one task.
PART_BYTES = 1 << 27
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
# Order of the parts in the output of each form.
ORDER = {"plain": ("prefix",), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
# Percent of documents that stay plain, and of the others in suffix-first order.
PLAIN_SHARE = 10
SPM_SHARE = 20

_PLACE = {"prefix": 0, "middle": 1, "suffix": 2}
_MARKED = {mark: part for part, mark in MARKS.items()}
# Pieces of one part at most; the part is in the position above it.
_PART = 1 << 40
_HEAD = -1


def plan(key, text: str) -> tuple[str, int, int]:
    """(form, end of prefix, end of middle) of a document; a null key counts as empty."""
    name = "" if key is None else str(key)
    h = hashlib.sha256(b"1:" + name.encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in _MARKED) or h3 % 100 >= 100 - PLAIN_SHARE:
        return "plain", n, n
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < SPM_SHARE else "psm"), a, b


def _codec() -> tuple:
    return worker_cache(("zstd",), lambda: (zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))


def _press(body: bytes) -> bytes:
    return _codec()[0].compress(body)


def _read(piece: bytes) -> bytes:
    return _codec()[1].decompress(piece)


def emit_pieces(row: int, key, text: str | None, chunk: int = CHUNK) -> Iterator[tuple]:
    """((row, output position), value): the document's head, then its pieces.

    The head carries (key, code points, form, prefix and middle sizes); each
    part begins with its mark in the same piece as its first characters.
    """
    text = text or ""
    form, a, b = plan(key, text)
    sizes = (None, None) if form == "plain" else (a, b - a)
    yield (row, _HEAD), (key, len(text), form, *sizes)
    parts = {"prefix": (0, a), "middle": (a, b), "suffix": (b, len(text))}
    for turn, part in enumerate(ORDER[form]):
        start, end = parts[part]
        mark = "" if form == "plain" else MARKS[part]
        for i, at in enumerate(range(start, max(end, start + 1), chunk)):
            lead = mark if i == 0 else ""
            yield (row, turn * _PART + i), _press((lead + text[at:min(at + chunk, end)]).encode())


def _by_row(key: tuple) -> int:
    return key[0]


def assemble(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> RDD:
    """Pieces of all documents in output order, a document's together.

    Rows are told apart by a number of their own, so null and repeated keys
    are documents each. Other columns are ignored; an empty table gives no
    pieces; a null text is the empty document.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def emit(own: Iterator) -> Iterator[tuple]:
        for r in own:
            yield from emit_pieces(r[0], r[1], r[2], chunk)

    return rows.rdd.mapPartitions(emit).repartitionAndSortWithinPartitions(parts, _by_row)


def _documents(pieces: Iterator[tuple]) -> Iterator[tuple[int, tuple, Iterator[tuple]]]:
    """(row, head, its pieces) one document at a time, nothing gathered."""
    for row, own in groupby(pieces, key=lambda p: p[0][0]):
        yield row, next(own)[1], own


def original_positions(form: str, bodies: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place before the cut, bytes without mark) of an output read in order.

    Marks open parts: they are in no text whose form is not plain, and no text
    around a mark can look like an earlier one, as each mark begins with its
    only ``<``. A piece that begins with a mark opens that part.
    """
    part, i = "prefix", 0
    for body in bodies:
        opened = None if form == "plain" else _MARKED.get(body[:3].decode("latin-1"))
        if opened:
            part, i, body = opened, 0, body[3:]
        yield _PLACE[part] * _PART + i, body
        i += 1


def digests(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """Heads with the digests of the output, read in order, and of the restored
    text: the pieces of one document, compressed, are sorted once more."""
    for _, head, own in _documents(pieces):
        written, restored = hashlib.sha256(), hashlib.sha256()

        def heard() -> Iterator[bytes]:
            for _, packed in own:
                body = _read(packed)
                written.update(body)
                yield body

        places = [(place, _press(body)) for place, body in original_positions(head[2], heard())]
        for _, packed in sorted(places):
            restored.update(_read(packed))
        yield (*head, written.hexdigest(), restored.hexdigest())


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: the key, ``n``, ``form``, ``prefix_chars``,
    ``middle_chars`` (null if plain), ``output_sha256`` and ``restored_sha256``.

    One shuffle of compressed pieces. Texts of any length pass as pieces; equal
    rows are rows each.
    """
    rows = assemble(docs, key, text, chunk).mapPartitions(digests)
    schema = StructType([
        StructField(key, docs.schema[key].dataType),
        StructField("n", LongType()), StructField("form", StringType()),
        StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()),
        StructField("output_sha256", StringType()), StructField("restored_sha256", StringType()),
    ])
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def transformed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The training texts themselves: the key, ``form`` and ``output``."""

    def join(pieces: Iterator[tuple]) -> Iterator[tuple]:
        for _, head, own in _documents(pieces):
            yield head[0], head[2], b"".join(_read(p) for _, p in own).decode()

    schema = StructType([
        StructField(key, docs.schema[key].dataType), StructField("form", StringType()), StructField("output", StringType()),
    ])
    rows = assemble(docs, key, text, chunk).mapPartitions(join)
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)
