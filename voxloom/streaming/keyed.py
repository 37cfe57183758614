"""Keyed processors: late rows as a side output, pauses, armed captures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxloom.operators.phrase_machine import CaptureRules, capture_end
from voxloom.session import parallelism

_NEVER = -(1 << 62)


def _in_lanes(rows: DataFrame, keys: Sequence[str], lanes: int | None) -> DataFrame:
    """``rows`` with ``_id``, the keys as text, and ``_lane``, the group they are worked on in.

    A call per key costs milliseconds, whatever it does, so many keys share a
    call and a state row. Rows with a null key keep to themselves: pandas would
    turn the other keys into floats. A restarted stream needs the same ``lanes``.
    """
    ids = [F.col(k).cast("string") for k in keys]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    lane = F.pmod(F.xxhash64(*keys), F.lit(lanes or parallelism(rows.sparkSession)))
    return rows.select("*", F.array(*ids).alias("_id"), F.when(known, lane).otherwise(-1).alias("_lane"))


class _Lane:
    """A lane's rows of one batch by key and order; ``of`` is a row's key number."""

    def __init__(self, parts: Iterator[pd.DataFrame], order: Sequence[str], known: Sequence) -> None:
        rows = pd.concat(list(parts), ignore_index=True)
        # Keys of the state come first, new ones after them.
        at = {tuple(k): i for i, k in enumerate(known)}
        rows["_of"] = [at.setdefault(tuple(k), len(at)) for k in rows["_id"]]
        self.ids = [list(k) for k in at]
        self.rows = rows.sort_values(["_of", *order], kind="stable", ignore_index=True)
        self.of = self.rows["_of"].to_numpy()
        self.starts = np.flatnonzero(np.diff(self.of, prepend=-1))
        self.ends = np.append(self.starts[1:], len(self.of))
        self.keys = self.of[self.starts]

    def running_max(self, values: np.ndarray) -> np.ndarray:
        return pd.Series(values).groupby(self.of).cummax().to_numpy()

    def sent(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.drop(columns=[c for c in ("_of", "_id", "_lane", "_us") if c in rows])


def mark_late(
    rows: DataFrame, key: str, arrival: str, ts: str, delay_s: int, lanes: int | None = None
) -> DataFrame:
    """All rows with ``late``: more than ``delay_s`` behind the newest time of
    their key that arrived before them.

    Every key keeps a low-water mark of its own, one number of state. Rows are
    judged in order of ``arrival``, so the result does not depend on how they
    fall into batches; late ones come out marked instead of being dropped.
    A row without a time is never late and moves no mark. ``lanes`` calls share
    the keys of a batch.
    """
    us = F.unix_micros(F.col(ts))
    sent = _in_lanes(rows.select("*", us.alias("_us")), [key], lanes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", late boolean"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, marks = state.get if state.exists else ([], [])
        lane = _Lane(parts, [arrival], ids)
        own = lane.rows
        newest = np.full(len(lane.ids), _NEVER, np.int64)
        newest[:len(marks)] = marks
        known = own["_us"].notna().to_numpy()
        at = own["_us"].fillna(_NEVER).to_numpy(np.int64)
        top = lane.running_max(at)
        before = np.concatenate(([_NEVER], top[:-1]))
        before[lane.starts] = _NEVER
        before = np.maximum(before, newest[lane.of])
        newest[lane.keys] = np.maximum(newest[lane.keys], top[lane.ends - 1])
        state.update((lane.ids, newest.tolist()))
        own["late"] = known & (before > _NEVER) & (at < before - delay_s * 1_000_000)
        yield lane.sent(own)

    return sent.groupBy("_lane").applyInPandasWithState(
        run, schema, "ids array<array<string>>, newest array<long>", "append", GroupStateTimeout.NoTimeout
    )


def gate_pauses_stream(
    rows: DataFrame, key: str, order: Sequence[str], control: str, lanes: int | None = None
) -> DataFrame:
    """Rows outside pauses with ``epoch``, the number of resumes before them.

    ``control`` is 'pause' or 'resume' on control rows and null on blocks. A
    key's state is whether it is paused and how often it resumed; a control row
    resets it for all that comes after, in whichever batch. ``lanes`` calls
    share the keys of a batch.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", epoch long"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, held, epochs = state.get if state.exists else ([], [], [])
        lane = _Lane(parts, order, ids)
        own = lane.rows
        paused, epoch = np.zeros(len(lane.ids), bool), np.zeros(len(lane.ids), np.int64)
        paused[:len(held)], epoch[:len(epochs)] = held, epochs
        said = own[control].notna().to_numpy()
        resumed = (own[control] == "resume").to_numpy()
        total = np.cumsum(resumed)
        first = np.repeat(lane.starts, lane.ends - lane.starts)
        resumes = epoch[lane.of] + total - total[first] + resumed[first]
        # The last control row up to each row, if its key has one in this batch.
        last = lane.running_max(np.where(said, np.arange(len(own)), -1))
        stopped = np.where(last >= 0, (own[control] == "pause").to_numpy()[np.maximum(last, 0)], paused[lane.of])
        paused[lane.keys], epoch[lane.keys] = stopped[lane.ends - 1], resumes[lane.ends - 1]
        state.update((lane.ids, paused.tolist(), epoch.tolist()))
        own["epoch"] = resumes
        yield lane.sent(own[~said & ~stopped])

    return _in_lanes(rows, [key], lanes).groupBy("_lane").applyInPandasWithState(
        run, schema, "ids array<array<string>>, paused array<boolean>, epoch array<long>", "append", GroupStateTimeout.NoTimeout
    )


def capture_stream(
    blocks: DataFrame, keys: Sequence[str], index: str, voiced: str, ts: str, rules: CaptureRules,
    idle_s: int = 600, lanes: int | None = None,
) -> DataFrame:
    """One capture per armed session of a block stream, as ``energy_captures``.

    A session leaves as soon as its end is certain, and needs no further input
    to do so: a timer set ``idle_s`` behind its last block closes one whose data
    stop early. The state is the session's blocks up to the farthest a capture
    can reach, and afterwards a mark that it is done, until the timer takes it
    away. Blocks may come in any order within the watermark's delay. ``lanes``
    calls share the sessions of a batch; a lane's timer is its first session's.
    """
    keys = list(keys)
    kinds = dict(blocks.dtypes)
    out = ", ".join(f"`{k}` string" for k in keys) + ", stop_reason string, onset_idx long, stop_idx long, kept_blocks long"
    names = [*keys, "stop_reason", "onset_idx", "stop_idx", "kept_blocks"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # By session: block numbers, their votes, done, and when it is over.
        ids, ats, heards, dones, dues = state.get if state.exists else ([], [], [], [], [])
        mark, found = state.getCurrentWatermarkMs(), []
        ats, heards, dones, dues = list(ats), list(heards), list(dones), list(dues)
        if not state.hasTimedOut:
            lane = _Lane(parts, [index], ids)
            ids = lane.ids
            fresh = len(ids) - len(ats)
            ats += [[]] * fresh
            heards += [[]] * fresh
            dones += [False] * fresh
            dues += [0] * fresh
            at_all, heard_all = lane.rows[index].to_numpy(), lane.rows[voiced].to_numpy()
            ms = lane.rows[ts].to_numpy("datetime64[ns]").astype(np.int64) // 1_000_000
            newest = np.maximum.reduceat(ms, lane.starts)
            for i, a, b, last in zip(lane.keys.tolist(), lane.starts.tolist(), lane.ends.tolist(), newest.tolist()):
                dues[i] = max(last, mark) + idle_s * 1000
                if dones[i]:
                    continue
                near = at_all[a:b] < rules.reach
                seen = dict(zip(ats[i], heards[i])) | dict(zip(at_all[a:b][near].tolist(), heard_all[a:b][near].tolist()))
                ats[i] = sorted(seen)
                heards[i] = [bool(seen[x]) for x in ats[i]]
                end = capture_end(np.array(ats[i], np.int64), np.array(heards[i], bool), rules, complete=False)
                if end is not None:
                    ats[i], heards[i], dones[i] = [], [], True
                    found.append((*ids[i], *end))
        kept = []
        for i, due in enumerate(dues):
            if due > mark:
                kept.append(i)
            elif not dones[i]:
                end = capture_end(np.array(ats[i], np.int64), np.array(heards[i], bool), rules, complete=True)
                found.append((*ids[i], *end))
        if kept:
            state.update(tuple([c[i] for i in kept] for c in (ids, ats, heards, dones, dues)))
            state.setTimeoutTimestamp(min(dues[i] for i in kept))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=names).astype({n: "Int64" for n in names[-3:]})

    closed = _in_lanes(blocks, keys, lanes).groupBy("_lane").applyInPandasWithState(
        run, out, "ids array<array<string>>, at array<array<long>>, heard array<array<boolean>>, done array<boolean>, due array<long>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    return closed.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})
