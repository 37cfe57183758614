"""Imperative work on many small ordered groups per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

Columns = dict[str, np.ndarray]


def map_sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[Columns], list[tuple]],
    schema: str | StructType,
) -> DataFrame:
    """Applies ``fn`` to every group of ``keys``, its rows sorted by ``order``.

    Like ``groupBy(...).applyInPandas``, but one Arrow batch may hold many
    groups, so small groups do not pay for a Python round trip each. A task
    holds one batch and the group that reaches over its end. ``fn`` gets the
    columns of one group as arrays and returns output rows.
    """
    keys, columns = list(keys), df.columns
    names = [part.split()[0] for part in schema.split(", ")] if isinstance(schema, str) else schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            if rest is not None and len(rest):
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            starts = _group_starts(batch, keys)
            rest = batch.iloc[starts[-1]:]
            rows = _rows(batch, starts, columns, fn)
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if rest is not None and len(rest):
            rows = fn({c: rest[c].to_numpy() for c in columns})
            if rows:
                yield pd.DataFrame(rows, columns=names)

    # No number: adaptive execution sizes the tasks by bytes. Partitioned by a hash
    # of the keys, not by the keys: over a join on the same keys Spark would leave
    # this shuffle out and read the join's in pieces, which cuts groups.
    placed = df.repartition(F.xxhash64(*[F.col(f"`{k}`") for k in keys]))
    return placed.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _group_starts(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    changed = np.zeros(len(batch), dtype=bool)
    changed[0] = True
    for k in keys:
        values = batch[k].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def _rows(batch, starts, columns, fn) -> list[tuple]:
    arrays = {c: batch[c].to_numpy() for c in columns}
    out: list[tuple] = []
    for begin, end in zip(starts[:-1], starts[1:]):
        out += fn({c: a[begin:end] for c, a in arrays.items()})
    return out
