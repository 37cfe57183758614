"""Token ids and counts of whole texts, encoded in batches balanced by bytes.

A byte-level BPE never merges over a boundary that its own pre-tokeniser
draws, so a text may be cut before a blank that stands between two characters
which are no white space, and the pieces encoded alone. Long texts are cut
there into pieces of bounded size; pieces fill batches of about equal bytes.

Pieces of plain Latin text go to the rank form of the same vocabulary, which
merges alike and is three times faster; pieces with other scripts, control
characters or special strings go to the tokeniser file itself, which also
defines what special strings become. Tests hold both against the tokeniser
file on whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.common import append_columns, split_by_bytes, worker_cache

TOKENIZER = "byte_bpe_50k.json"
# The same vocabulary as ranks, by tokeniser file.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}
# Bytes of text encoded together, and of one piece of a long text.
BATCH_BYTES = 4 << 20
PIECE_BYTES = 1 << 18
# A blank between characters that no library counts as white space.
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
# Where libraries may differ: controls, odd blanks, scripts beyond Latin.
_OTHER = re.compile("[^\n\x20-\x7e\xa1-\u024f]")


class Encoder:
    """Token ids of pieces, in the order given."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.ranks = self._rank_form(public_tokenizers, RANKS.get(name))

    @staticmethod
    def _rank_form(files, name):
        if name is None:
            return None
        import base64

        import tiktoken

        with open(files.path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(
            name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )._core_bpe

    def _plain(self, text: str) -> bool:
        return (
            self.ranks is not None and not _OTHER.search(text)
            and not any(s in text for s in self.special)
        )

    def __call__(self, pieces: list[str]) -> list[list[int]]:
        out: list = [self.ranks.encode_ordinary(p) if self._plain(p) else None for p in pieces]
        rest = [i for i, ids in enumerate(out) if ids is None]
        coded = self.model.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, coded):
            out[i] = e.ids
        return out


def safe_pieces(text: str, limit: int = PIECE_BYTES) -> list[str]:
    """``text`` in pieces of about ``limit`` characters that encode alone."""
    out, start = [], 0
    while len(text) - start > limit:
        cut = _CUT.search(text, start + limit - 1)
        if cut is None:
            break
        out.append(text[start:cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encoded(texts: Sequence[bytes], name: str) -> Iterator[list[list[int]]]:
    """For every text the ids of its pieces; encoded in byte-balanced batches."""
    encode = worker_cache(("encoder", name), lambda: Encoder(name))
    for s, e in split_by_bytes(map(len, texts), BATCH_BYTES):
        pieces = [safe_pieces(t.decode("utf-8")) for t in texts[s:e]]
        ids = iter(encode([p for own in pieces for p in own]))
        for own in pieces:
            yield [next(ids) for _ in own]


def encode_lengths(texts: Sequence[bytes], name: str = TOKENIZER) -> np.ndarray:
    """Tokens of every text."""
    return np.fromiter((sum(map(len, own)) for own in encoded(texts, name)), np.int64, len(texts))


def encode_ids(texts: Sequence[bytes], name: str = TOKENIZER) -> Iterator[np.ndarray]:
    """Token ids of every text as unsigned 32-bit numbers."""
    for own in encoded(texts, name):
        ids = [np.array(p, dtype=np.uint32) for p in own]
        yield ids[0] if len(ids) == 1 else np.concatenate(ids)


def token_counts(
    docs: DataFrame, text: str = "text", limit: int = 1024, tokenizer: str = TOKENIZER
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    A map over the scan: no shuffle, only lengths leave the function. A null
    text counts as empty (0 bytes, 0 tokens); repeated rows are counted each;
    an empty table gives an empty table; input columns with these three names
    are replaced.
    """

    def score(texts: list[bytes]) -> list[pa.Array]:
        n = encode_lengths(texts, tokenizer)
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)]

    return append_columns(docs, text, "n_bytes long, n_tokens long, over_limit boolean", score)
