"""Vector bin packing of token sequences under simultaneous limits.

Every example is a vector (tokens, segments, loss-bearing tokens) and a
sequence offers a capacity for each. Sequences are filled one at a time: of the
waiting pieces that fit, the one with the largest dot product of its share of
the capacities with what the sequence has left goes in. When none fits, the
largest waiting piece is cut to fill the rest exactly, so only the last
sequence of a partition is short.

It runs as a map over the scan: a partition packs its own rows in batches of
bounded size and hands unfinished pieces to the next batch. No row is
shuffled, and a lost executor repacks just its partitions, with equal ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm.common import private
from voxloom.llm.tokens import TOKENIZER, encode_ids

# Id that ends a document.
SEPARATOR = 0
# Sequence numbers a partition may use.
_PER_PARTITION = 1 << 36
# Pieces among which the dot product chooses.
_WAITING = 2048


@dataclass(frozen=True)
class Limits:
    """Capacity of a sequence. A bearing piece has loss on all its tokens."""

    tokens: int = 1024
    segments: int = 1024
    loss_tokens: int = 1024


class Packer:
    """Fills sequences from a pool of pieces (key, start, length, bearing)."""

    def __init__(self, limits: Limits, first_sequence: int) -> None:
        self.limits, self.sequence = limits, first_sequence
        self.pool: list[tuple[int, int, int, bool]] = []
        self.done: list[tuple[int, int, int, int, int]] = []

    def add(self, key: int, length: int, bearing: bool) -> None:
        """An example; stretches that fill a sequence alone are placed at once."""
        most = self.limits.tokens if not bearing else min(self.limits.tokens, self.limits.loss_tokens)
        start = 0
        while length - start >= most:
            self.done.append((key, start, most, self.sequence, 0))
            self.sequence += 1
            start += most
        if length > start:
            self.pool.append((key, start, length - start, bearing))

    def fill(self, last: bool) -> None:
        """Packs the pool: all of it if ``last``, else down to a small rest."""
        caps = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        pool, self.pool = self.pool, []
        for at in range(0, len(pool), _WAITING):
            self.pool += pool[at:at + _WAITING]
            self._fill(caps, last and at + _WAITING >= len(pool))

    def _fill(self, caps: np.ndarray, last: bool) -> None:
        pieces = list(self.pool)
        size = np.array([p[2] for p in pieces], dtype=float)
        bears = np.array([p[3] for p in pieces], dtype=bool)
        waits = np.ones(len(pieces), dtype=bool)
        while waits.any() and (last or size[waits].sum() >= 2 * caps[0]):
            left, offset = caps.copy(), 0
            while left[0] >= 1 and left[1] >= 1:
                room = np.where(bears, min(left[0], left[2]), left[0])
                fits = waits & (size <= room)
                # Dot product of each piece's share of the capacities with what is left of them.
                score = size / caps[0] * (left[0] / caps[0]) + (1 / caps[1]) * (left[1] / caps[1])
                score += np.where(bears, size / caps[2] * (left[2] / caps[2]), 0.0)
                if fits.any():
                    at = int(np.argmax(np.where(fits, score, -1.0)))
                    take = int(size[at])
                else:
                    usable = waits & (room >= 1)
                    if not usable.any():
                        break
                    at = int(np.argmax(np.where(usable, size, -1.0)))
                    take = int(room[at])
                key, start, length, bearing = pieces[at]
                self.done.append((key, start, take, self.sequence, offset))
                if take == length:
                    waits[at] = False
                else:
                    pieces[at] = (key, start + take, length - take, bearing)
                    size[at] = length - take
                offset += take
                left -= (take, 1, take if bearing else 0)
            self.sequence += 1
        self.pool = [p for p, w in zip(pieces, waits.tolist()) if w]


PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    bearing: Column | None = None,
    limits: Limits = Limits(),
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """Pieces of all documents with their place in sequences.

    Columns: the key, ``start`` and ``length`` in the document's ids (its
    tokens and a closing separator), ``ids_crc32`` of the piece's ids,
    ``doc_tokens``, ``sequence_id`` and ``offset``. Every id lies in exactly
    one piece. ``bearing`` marks documents with loss on their tokens (default:
    all; null counts as false). A null or empty text is the separator alone;
    null and repeated keys are packed row by row; other columns are ignored;
    an empty table gives no pieces. Sequence ids are unique over the table.
    """
    kind = docs.schema[key].dataType.simpleString()
    body, flag = private(docs, "text"), private(docs, "bearing")
    source = docs.select(
        F.col(f"`{key}`"),
        F.col(f"`{text}`").alias(body),
        F.coalesce(F.lit(True) if bearing is None else bearing, F.lit(False)).alias(flag),
    )

    def emit(packer: Packer, keys: dict, ids: dict) -> pa.RecordBatch:
        rows = packer.done
        packer.done = []
        crc = [
            zlib.crc32(ids[k][s:s + n].astype("<u4").tobytes()) for k, s, n, _, _ in rows
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([keys[r[0]] for r in rows], key_type),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array([len(ids[r[0]]) for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
            ],
            names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() * _PER_PARTITION)
        keys: dict[int, object] = {}
        ids: dict[int, np.ndarray] = {}
        n = 0
        for b in batches:
            texts = [b"" if t is None else t for t in b.column(1).cast(pa.binary()).to_pylist()]
            for k, own, bears in zip(b.column(0).to_pylist(), encode_ids(texts, tokenizer), b.column(2).to_pylist()):
                keys[n], ids[n] = k, np.append(own, np.uint32(SEPARATOR))
                packer.add(n, len(own) + 1, bears)
                n += 1
            packer.fill(last=False)
            yield emit(packer, keys, ids)
            open_ = {p[0] for p in packer.pool}
            keys = {k: keys[k] for k in open_}
            ids = {k: ids[k] for k in open_}
        packer.fill(last=True)
        yield emit(packer, keys, ids)

    return source.mapInArrow(run, f"`{key}` {kind}, {PIECES}")
