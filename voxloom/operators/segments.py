"""Block streams: votes, runs, pre-roll, check schedules and phrase segmentation.

Blocks are rows (device_id, block_idx, ts, voiced, energy) with a dense index
per device; ``energy`` is the mean square of the block's samples, so that a
phrase's rms is the root of its mean energy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.operators.grouped import map_sorted_groups
from voxloom.operators.ordered import bucket_running, with_halo
from voxloom.operators.phrase_machine import BlockRun, SegmentRules
from voxloom.session import materialise

CHUNK_BLOCKS = 4096
CHAIN_FAN = 1024


DEFAULT_RULES = SegmentRules()
VOICED_FRAME_RATIO = 0.60
MIN_RMS = 0.008
NOISE_FACTOR = 3.0


def block_votes(frames: DataFrame, keys: Sequence[str], voiced: Column, full: Column) -> DataFrame:
    """Share of voiced frames per block and the vote; partial frames do not count."""
    share = F.coalesce(F.avg(F.when(full, voiced.cast("double"))), F.lit(0.0))
    return frames.groupBy(*keys).agg(
        F.count_if(full).alias("frames"), share.alias("ratio")
    ).withColumn("voiced", F.col("ratio") >= VOICED_FRAME_RATIO)


def onset_votes(blocks: DataFrame, rules: SegmentRules = DEFAULT_RULES, chunk: int = CHUNK_BLOCKS) -> DataFrame:
    """Rolling vote over the last ``window`` blocks; it needs a full window."""
    w = Window.partitionBy("device_id", "chunk").orderBy("block_idx").rowsBetween(1 - rules.window, 0)
    return (
        with_halo(blocks, "block_idx", chunk, rules.window - 1)
        .withColumn("votes", F.sum(F.col("voiced").cast("long")).over(w))
        .withColumn("onset", (F.count(F.lit(1)).over(w) == rules.window) & (F.col("votes") >= rules.required))
        .where(~F.col("is_halo"))
        .drop("chunk", "is_halo")
    )


def silence_runs(blocks: DataFrame, rules: SegmentRules = DEFAULT_RULES, chunk: int = CHUNK_BLOCKS) -> DataFrame:
    """Trailing unvoiced blocks and seconds at every block."""
    chunked = blocks.withColumn("_chunk", F.floor(F.col("block_idx") / chunk))
    runs = bucket_running(
        chunked, ["device_id"], "_chunk", ["block_idx"],
        lasts={"_voiced_at": F.when(F.col("voiced"), F.col("block_idx"))},
    )
    run = F.col("block_idx") - F.coalesce("_voiced_at", F.lit(-1))
    return runs.withColumn("silent_blocks", run).withColumn(
        "silence_s", run * rules.block_s
    ).drop("_chunk", "_voiced_at")


def pre_rolls(blocks: DataFrame, rules: SegmentRules = DEFAULT_RULES, chunk: int = CHUNK_BLOCKS) -> DataFrame:
    """For every onset block, the blocks kept before it (itself included)."""
    reach = max(rules.pre_roll, rules.window)
    order = Window.partitionBy("device_id", "chunk").orderBy("block_idx")
    kept, recent = order.rowsBetween(1 - rules.pre_roll, 0), order.rowsBetween(1 - rules.window, 0)
    # One halo is long enough for the votes and for the pre-roll.
    return (
        with_halo(blocks, "block_idx", chunk, reach - 1)
        .withColumn("_full", F.count(F.lit(1)).over(recent) == rules.window)
        .withColumn("_votes", F.sum(F.col("voiced").cast("int")).over(recent))
        .withColumn("pre_roll", F.collect_list("block_idx").over(kept))
        .withColumn("pre_roll_rms", F.sqrt(F.avg("energy").over(kept)))
        .where(~F.col("is_halo") & F.col("_full") & (F.col("_votes") >= rules.required))
        .select("device_id", "block_idx", "pre_roll", "pre_roll_rms")
    )


def prefix_schedule(
    phrase_blocks: DataFrame,
    keys: Sequence[str],
    position: str,
    energy: str,
    first: int = 15,
    step: int = 5,
    cap: int = 40,
    min_rms: float = MIN_RMS,
    detected_at: str | None = None,
) -> DataFrame:
    """Keyword checks of growing prefixes of each phrase.

    From ``first`` blocks every ``step`` blocks up to ``cap``, then once more
    at the end unless that prefix was already looked at. Quiet prefixes are
    scheduled as skipped. Checks after ``detected_at`` blocks are dropped.
    Every prefix is a conditional sum, so a phrase is never collected.
    """
    marks = list(range(first, cap + 1, step))
    p = F.col(position)
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(F.when(p < cap, F.col(energy))).alias("_e_final")]
    aggs += [F.sum(F.when(p < m, F.col(energy))).alias(f"_e{m}") for m in marks]
    if detected_at:
        aggs.append(F.max(detected_at).alias("_hit"))
    phrases = phrase_blocks.groupBy(*keys).agg(*aggs)
    final = F.least(F.col("_n"), F.lit(cap))
    last_mark = F.greatest(*[F.when(F.col("_n") >= m, F.lit(m)).otherwise(0) for m in marks], F.lit(0))
    checks = F.array(
        *[
            F.when(F.col("_n") >= m, F.struct(F.lit(m).cast("long").alias("prefix"), F.lit(False).alias("is_final"), F.col(f"_e{m}").alias("e")))
            for m in marks
        ],
        F.when(final > last_mark, F.struct(final.cast("long").alias("prefix"), F.lit(True).alias("is_final"), F.col("_e_final").alias("e"))),
    )
    out = phrases.select(
        *keys, *(["_hit"] if detected_at else []), F.explode(F.array_compact(checks)).alias("c")
    )
    if detected_at:
        out = out.where(F.col("_hit").isNull() | (F.col("c.prefix") <= F.col("_hit")))
    return out.select(*keys, "c.prefix", "c.is_final", F.sqrt(F.col("c.e") / F.col("c.prefix")).alias("rms")).withColumn(
        "submitted", F.col("rms") >= min_rms
    )


def noise_thresholds(calibration: DataFrame, key: str, rms: str) -> DataFrame:
    """Speech threshold from calibration blocks, a fixed small number per key."""
    return calibration.groupBy(key).agg(F.median(rms).alias("noise_floor")).withColumn(
        "threshold", F.greatest(F.lit(MIN_RMS), F.col("noise_floor") * NOISE_FACTOR)
    )


def phrase_sessions(blocks: DataFrame, rules: SegmentRules = DEFAULT_RULES, chunk: int = CHUNK_BLOCKS) -> DataFrame:
    """Voiced blocks grouped into sessions closed by ``end_silence`` silent blocks."""
    voiced = blocks.where("voiced").withColumn("_chunk", F.floor(F.col("block_idx") / chunk))
    seen = bucket_running(
        voiced, ["device_id"], "_chunk", ["block_idx"], before={"_prev": F.col("block_idx")}
    )
    fresh = F.col("_prev").isNull() | (F.col("block_idx") - F.col("_prev") > rules.end_silence)
    marked = bucket_running(
        seen, ["device_id"], "_chunk", ["block_idx"],
        lasts={"session_start": F.when(fresh, F.col("block_idx"))},
    )
    return marked.groupBy("device_id", "session_start").agg(
        F.max("block_idx").alias("session_end"),
        F.count("*").alias("voiced_blocks"),
        F.sqrt(F.avg("energy")).alias("rms"),
    )


def gate_pauses(rows: DataFrame, key: str, order: Sequence[str], bucket: str, control: str) -> DataFrame:
    """Drops rows inside pauses; ``epoch`` counts resumes.

    ``control`` is 'pause' or 'resume' on control rows and null on blocks.
    Adding ``epoch`` to later grouping keys keeps pre-roll and votes from
    crossing a pause.
    """
    c = F.col(control)
    running = bucket_running(
        rows, [key], bucket, order, lasts={"_state": c}, sums={"epoch": (c == "resume").cast("long")}
    )
    return running.where(c.isNull() & ~F.coalesce(F.col("_state") == "pause", F.lit(False))).drop("_state")


def pad_recordings(blocks: DataFrame, before: int = 10, after: int = 20) -> DataFrame:
    """Silent blocks around every recording; indexes start at ``-before``."""
    edges = blocks.groupBy("device_id").agg(F.max("block_idx").alias("_last"))

    def silent(index: Column) -> DataFrame:
        return edges.select(
            "device_id", F.explode(index).alias("block_idx"), F.lit(False).alias("voiced"), F.lit(0.0).alias("energy")
        )

    return (
        blocks.select("device_id", "block_idx", "voiced", "energy")
        .unionByName(silent(F.sequence(F.lit(-before).cast("long"), F.lit(-1).cast("long"))))
        .unionByName(silent(F.sequence(F.col("_last") + 1, F.col("_last") + after)))
    )


# ---------------------------------------------------------------------------
# Phrase segmentation. A chunk of blocks is a function from the state it is
# entered in to the state it is left in. Chunks compute that function on their
# own, the small functions are chained per device, and a second pass over the
# chunks with known entry states emits the phrases.
# ---------------------------------------------------------------------------


def _follow(exits, state: int) -> int:
    return int(exits[state] if len(exits) > 1 else exits[0])


def _chain_entries(functions: DataFrame, kind: str, fan: int = CHAIN_FAN) -> DataFrame:
    """Entry state of the chunk after every full chunk.

    State functions compose, and composition is associative: ``fan`` chunks
    become one function, those are followed per device, and the states found
    are then followed inside each run of chunks. A group never holds more
    than ``fan`` functions below the device level.
    """
    runs = functions.withColumn("run", F.floor(F.col("chunk") / fan))

    def compose(g: dict) -> list[tuple]:
        total = None
        for exits in g["exits"]:
            if total is None or len(exits) == 1:
                total = list(exits)
            else:
                total = [int(exits[t]) for t in total]
        return [(g["device_id"][0], int(g["run"][0]), [int(t) for t in total])]

    def follow_runs(g: dict) -> list[tuple]:
        state, out = 0, []
        for device, run, exits in zip(g["device_id"], g["run"], g["exits"]):
            out.append((device, int(run), state))
            state = _follow(exits, state)
        return out

    def follow_chunks(g: dict) -> list[tuple]:
        state, out = int(g["start"][0]), []
        for device, at, exits in zip(g["device_id"], g["chunk"], g["exits"]):
            state = _follow(exits, state)
            out.append((device, int(at) + 1, state))
        return out

    composed = map_sorted_groups(
        runs, ["device_id", "run"], ["chunk"], compose, f"device_id {kind}, run bigint, exits array<int>"
    )
    starts = map_sorted_groups(
        composed, ["device_id"], ["run"], follow_runs, f"device_id {kind}, run bigint, start int"
    )
    return map_sorted_groups(
        runs.join(starts, ["device_id", "run"]), ["device_id", "run"], ["chunk"], follow_chunks,
        f"device_id {kind}, chunk bigint, entry int",
    )


def segment_phrases(
    blocks: DataFrame,
    rules: SegmentRules = DEFAULT_RULES,
    chunk: int = CHUNK_BLOCKS,
    fan: int = CHAIN_FAN,
) -> DataFrame:
    """Phrases of every device, exactly as a sequential pass would cut them.

    No task holds more than a batch of blocks plus one chunk with the longest
    phrase before it. A device contributes one small row per full chunk to
    the chaining step, and devices shorter than a chunk skip that step.
    Phrases still open at the end of a device's data are not emitted.
    """
    if chunk < rules.max_blocks:
        raise ValueError("a chunk must hold a whole phrase")
    kind, time_type = dict(blocks.dtypes)["device_id"], dict(blocks.dtypes)["ts"]
    # Times cross into Python as integers, which Arrow hands over as they are.
    columns = ["device_id", "block_idx", "us", "voiced", "energy"]
    timed = blocks.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select(*columns)
    sliced = with_halo(timed, "block_idx", chunk, rules.max_blocks)
    full = blocks.where(F.pmod("block_idx", F.lit(chunk)) == chunk - 1).select(
        "device_id", F.floor(F.col("block_idx") / chunk).cast("long").alias("chunk")
    )
    keys, order = ["device_id", "chunk"], ["block_idx"]

    def to_function(g: dict) -> list[tuple]:
        first = int(g["is_halo"].sum())
        run = BlockRun(g["voiced"].astype(bool), first, rules)
        # Only the first chunk of a device has a known entry state.
        exits = [run.run(0)[1]] if g["chunk"][0] == 0 else run.exits()
        return [(g["device_id"][0], int(g["chunk"][0]), [int(x) for x in exits])]

    def to_phrases(g: dict) -> list[tuple]:
        first = int(g["is_halo"].sum())
        if first == len(g["block_idx"]):
            return []
        ends, _ = BlockRun(g["voiced"].astype(bool), first, rules).run(int(g["entry"][0]))
        total = np.concatenate([[0.0], np.cumsum(g["energy"].astype(float))])
        index, us, out = g["block_idx"], g["us"], []
        for at, length, reason in ends:
            if length < rules.min_blocks:
                continue
            begin = at - length + 1
            mean = max((total[at + 1] - total[begin]) / length, 0.0)
            out.append((
                g["device_id"][0], int(index[begin]), int(index[at]), int(us[begin]), int(us[at]), length,
                length * rules.block_s, float(np.sqrt(mean)), reason,
            ))
        return out

    schema = (
        f"device_id {kind}, start_idx bigint, end_idx bigint, start_ts bigint, end_ts bigint, "
        "n_blocks bigint, duration_s double, rms double, end_reason string"
    )
    opening = sliced.where("chunk = 0").withColumn("entry", F.lit(0))
    # One small row per full chunk, read by every level of the chaining.
    functions = materialise(map_sorted_groups(
        sliced.select(*keys, *order, "voiced", "is_halo").join(full, keys, "left_semi"), keys, order, to_function,
        f"device_id {kind}, chunk bigint, exits array<int>",
    ), "chunk-functions")
    phrases = map_sorted_groups(opening, keys, order, to_phrases, schema)
    if not functions.isEmpty():
        later = sliced.where("chunk > 0").join(_chain_entries(functions, kind, fan), keys)
        phrases = phrases.unionByName(map_sorted_groups(later, keys, order, to_phrases, schema))
    return phrases.withColumns(
        {c: F.timestamp_micros(c).cast(time_type) for c in ("start_ts", "end_ts")}
    )


def energy_captures(
    blocks: DataFrame,
    keys: Sequence[str],
    index: str,
    voiced: str,
    window: int = 3,
    required: int = 3,
    pre_roll: int = 3,
    start_timeout: int = 80,
    end_silence: int = 12,
    max_blocks: int = 200,
    min_blocks: int = 0,
    post_roll: int = 2,
) -> DataFrame:
    """One capture per armed session: NO_SPEECH, END_SILENCE or MAX_DURATION.

    A session waits for speech up to ``start_timeout`` blocks, then records
    until enough silence or the maximum. Only the blocks a capture can reach
    are looked at, which bounds every session whatever it contains; a session
    whose data ends first is OPEN. Trailing silence beyond ``post_roll`` is cut.
    """
    keys = list(keys)
    i, v = F.col(index), F.col(voiced)
    reach = blocks.where(i < start_timeout + max_blocks)
    order = Window.partitionBy(*keys).orderBy(index)
    recent = order.rowsBetween(1 - window, 0)
    full = order.rowsBetween(Window.unboundedPreceding, 0)
    votes = reach.withColumn(
        "_start",
        (F.count(F.lit(1)).over(recent) == window)
        & (F.sum(v.cast("int")).over(recent) >= required)
        & (i < start_timeout),
    )
    whole = Window.partitionBy(*keys)
    onset = votes.withColumn("_onset", F.min(F.when(F.col("_start"), i)).over(whole))
    after = i > F.col("_onset")
    taken = F.least(F.col("_onset") + 1, F.lit(pre_roll))
    tracked = onset.withColumn(
        "_voice", F.max(F.when(v & (i >= F.col("_onset")), i)).over(full)
    ).withColumn("_count", i - F.col("_onset") + taken).withColumn(
        "_silent", i - F.coalesce("_voice", F.col("_onset"))
    )
    enough = after & (F.col("_silent") >= end_silence) & (F.col("_count") >= min_blocks)
    capped = after & (F.col("_count") >= max_blocks)
    ended = tracked.groupBy(*keys).agg(
        F.max("_onset").alias("onset_idx"),
        F.min(F.when(enough, F.struct(i.alias("at"), F.col("_count").alias("n"), F.col("_silent").alias("s")))).alias("_e"),
        F.min(F.when(capped, F.struct(i.alias("at"), F.col("_count").alias("n"), F.col("_silent").alias("s")))).alias("_m"),
        F.max(i).alias("_last"),
    )
    by_silence = F.col("_e").isNotNull() & (F.col("_m").isNull() | (F.col("_e.at") <= F.col("_m.at")))
    reason = (
        F.when(F.col("onset_idx").isNull() & (F.col("_last") + 1 >= start_timeout), "NO_SPEECH")
        .when(F.col("onset_idx").isNull(), "OPEN")
        .when(by_silence, "END_SILENCE")
        .when(F.col("_m").isNotNull(), "MAX_DURATION")
        .otherwise("OPEN")
    )
    stop = F.when(reason == "NO_SPEECH", F.lit(start_timeout - 1)).when(by_silence, F.col("_e.at")).otherwise(F.col("_m.at"))
    silent = F.when(by_silence, F.col("_e.s")).otherwise(F.col("_m.s"))
    n = F.when(by_silence, F.col("_e.n")).otherwise(F.col("_m.n"))
    return ended.select(
        *keys,
        reason.alias("stop_reason"),
        "onset_idx",
        stop.cast("long").alias("stop_idx"),
        F.when(reason.isin("END_SILENCE", "MAX_DURATION"), n - F.greatest(silent - post_roll, F.lit(0)))
        .cast("long").alias("kept_blocks"),
    )
