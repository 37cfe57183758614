"""Streams over tables that are folders of files in no particular order."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from voxloom.operators import segments as sg
from voxloom.operators.ordered import bucket_running, time_bucketed
from voxloom.operators.phrase_machine import CaptureRules, capture_end
from voxloom.plans import stream_queries as sq
from voxloom.plans.registry import Tables
from voxloom.session import shared_dir
from voxloom.streaming import keyed as kd, phrases as ph, replay as rp

SOURCE = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """The events as four files, each with rows from everywhere."""
    root = tmp_path_factory.mktemp("shuffled")
    spark.read.parquet(SOURCE).repartition(4, F.xxhash64("event_id")).write.parquet(str(root / "events.parquet"))
    return Tables(spark, str(root))


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def thousand_blocks(t):
    idx = F.col("event_id") % 1024
    return t("events").select(
        F.floor(F.col("event_id") / 1024).alias("device_id"), idx.alias("block_idx"), "ts",
        (F.col("value") >= F.when(F.floor(idx / 24) % 2 == 0, 15.0).otherwise(120.0)).alias("voiced"),
        F.pow(F.col("value") / 1000.0, F.lit(2.0)).alias("energy"),
    )


@pytest.mark.parametrize("slices", [2, 12])
def test_windows_close_before_the_end(shuffled, slices):
    done = sq.telemetry_replay(shuffled, slices)
    got = done.rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "peak", "n")
    assert rows(got) == rows(sq.telemetry_window(shuffled).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))
    # 477 windows in all: the state holds those of a slice, not of the table.
    assert done.batches >= slices and (slices == 2 or done.peak_state < 100)


def test_phrases_of_a_folder(shuffled):
    want = rows(sq.ad.rounded(sg.segment_phrases(thousand_blocks(shuffled))))
    assert want and rows(sq.phrase_replay(shuffled, 3)) == rows(sq.phrase_replay(shuffled, 9)) == want


def test_deliveries_of_a_folder(shuffled):
    want = [
        (r["user_id"], "delivered" if r["value"] >= 50 else "discarded", r["event_id"],
         f"heard {r['event_id']}" if r["value"] >= 50 else None)
        for r in shuffled("events").where("event_type = 'purchase'").collect()
    ]
    done = sq.wake_replay(shuffled, 16)
    assert rows(done.rows.select("phrase_id", "device_id", "wake_text", "outcome")) == sorted(want, key=str)
    # 202 phrases and 404 decisions pass through.
    assert done.peak_state < 100


def test_deliveries_share_state_by_lanes(spark, shuffled):
    """State rows follow the lanes and stores the cores, not the phrases, decisions and shuffle partitions."""
    wide, stores = spark.conf.get("spark.sql.shuffle.partitions"), []
    staged = rp.Slices(spark, "", None, "ts", 2 + rp.BEATS, 1000)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        done = sq.wake_replay(shuffled, 2)
        stores = [staged.partitions, replace(staged, rows=12 * 8192 * 16).partitions, replace(staged, rows=10 ** 9).partitions]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9" and 0 < done.peak_state <= 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide)
    assert stores == [4, 6, 9] and done.rows.count() == 202


@pytest.mark.parametrize("turn", [1, -1])
def test_decisions_within_the_wait(spark, turn):
    """Edges of the wait, equal times, repeats, null keys and odd columns, in whichever slice they come."""
    big, minute = 2 ** 53 + 1, 60_000_000
    said = [
        (1, big, 0, True, "early"), (1, big, 0, True, "earlier"), (1, big, 1, True, "a later one"), (1, big, -1, False, "no"),
        (1, 2, -minute, True, "first edge"), (1, 3, minute, True, "last edge"), (1, 4, minute + 1, True, "beyond"),
        (1, 5, -minute - 1, True, "before"), (None, 6, 5, True, "nobody's"), (1, None, 5, True, "of nothing"), (2, 2, 0, True, "other"),
        (1, 7, 0, True, None), (1, big - 1, 0, True, "near number"), (1, 8, -minute - 1, True, "too soon"), (1, 8, 3, True, "in time"),
    ]
    ended = [(1, big), (1, big), (1, 2), (1, 3), (1, 4), (1, 5), (None, 6), (1, None), (1, 7), (1, 8), (3, 2)]
    note = {2: None, 3: float("nan")}
    rows_ = [("d", d, p, us, hit, text, None, None) for d, p, us, hit, text in said] + [
        ("p", d, p, 0, None, None, None if p == 2 else big, note.get(p, 0.1)) for d, p in ended
    ]
    df = spark.createDataFrame(rows_, "kind string, device_id long, phrase_id long, us long, detected boolean, wake_text string, n long, x double")
    df = df.withColumn("ts", F.timestamp_micros(F.col("us") + 1_700_000_000_123_457))
    # Within the delay nothing is late: phrases before their decisions, and after them.
    slice_ = F.when(F.col("kind") == "p", 1 + turn).otherwise(1)
    staged = rp.stage(df, slice_, "ts", "edges")
    assert staged.count == 2 + rp.BEATS

    def side(kind, ts, *columns):
        real = F.when(F.col(ts).isNotNull(), F.col("kind") == kind)
        return staged.stream().withColumnRenamed("ts", ts).withWatermark(ts, "10 minutes").where(real).select(*columns)

    done = rp.drain_whole(ph.deliver_confirmed(
        side("p", "end_ts", "device_id", "phrase_id", "end_ts", "n", "x"),
        side("d", "ts", "device_id", "phrase_id", "ts", "detected", "wake_text"), lanes=3,
    ), "edges")
    heard = {
        (1, big): "earlier", (1, 2): "first edge", (1, 3): "last edge", (None, 6): "nobody's", (1, None): "of nothing",
        (1, 7): None, (1, 8): "in time",
    }
    want = [(d, p, None if p == 2 else big, str(note.get(p, 0.1)), heard.get((d, p)), "delivered" if (d, p) in heard else "discarded")
            for d, p in set(ended)]
    got = [(r["device_id"], r["phrase_id"], r["n"], str(r["x"]), r["wake_text"], r["outcome"]) for r in done.rows.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and done.peak_state <= 3
    assert {r[0] for r in done.rows.select(F.unix_micros("end_ts")).collect()} == {1_700_000_000_123_457}


def test_late_blocks_do_not_depend_on_batches(shuffled):
    got = rows(sq.late_replay(shuffled, 3))
    assert got == rows(sq.late_replay(shuffled, 10)) and sum(r[2] for r in got) > 10


def test_pauses_and_captures_do_not_depend_on_batches(shuffled):
    want = rows(sq.pause_gate(shuffled))
    assert rows(sq.pause_replay(shuffled, 2)) == rows(sq.pause_replay(shuffled, 9)) == want
    want = rows(sq.energy_segments(shuffled).select("device_id", "session", "stop_reason", "onset_idx", "stop_idx", "kept_blocks"))
    assert rows(sq.capture_replay(shuffled, 7).rows) == want and any("OPEN" in map(str, r) for r in want)


def test_keys_share_the_calls_of_a_batch(spark, shuffled):
    """State rows, and with them calls, follow the lanes, not the keys; null keys keep to themselves."""
    events = shuffled("events").withColumns({
        "ts": F.col("ts").cast("timestamp"), "user_id": F.when(F.col("event_id") % 50 != 7, F.col("user_id")),
        "control": F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "purchase", "resume"),
    }).select("user_id", "event_id", "ts", "control")
    assert events.select("user_id").distinct().count() > 10
    staged = rp.stage(events, sq.slices_by_time(events, "ts", 3), "ts", "lanes")
    late = rp.drain_whole(kd.mark_late(staged.stream("1 minute"), "user_id", "event_id", "ts", 3 * 3600), "lanes")
    gated = rp.drain_whole(kd.gate_pauses_stream(staged.stream("1 minute"), "user_id", ["ts", "event_id"], "control"), "lanes")
    blocks = staged.stream("1 minute").selectExpr("user_id", "event_id % 40 AS i", "control IS NULL AS voiced", "ts")
    rules = CaptureRules(start_timeout=12, end_silence=6, max_blocks=25)
    ends = rp.drain_whole(kd.capture_stream(blocks, ["user_id"], "i", "voiced", "ts", rules), "lanes")
    for done in (late, gated, ends):
        assert 0 < done.peak_state <= 5
    users = {r[0] for r in events.select("user_id").collect()}
    assert late.rows.count() == events.count() and {r[0] for r in ends.rows.select("user_id").collect()} == users
    bucketed = time_bucketed(events, "ts", "_span")
    want = sg.gate_pauses(bucketed, "user_id", ["ts", "event_id"], "_span", "control").select("user_id", "event_id", "epoch")
    assert rows(gated.rows.select("user_id", "event_id", "epoch")) == rows(want)


def test_a_run_split_in_two(spark, shuffled):
    """A replay that stops after some slices and goes on later gives the phrases of one run."""
    blocks = thousand_blocks(shuffled).withColumn("ts", F.col("ts").cast("timestamp"))
    want = rows(sq.ad.rounded(rp.drain(ph.segment_stream(rp.stage(blocks, sq.slices_by_time(blocks, "ts", 4), "ts", "whole").stream("1 minute")), "whole").rows))
    marks = blocks.agg(F.expr("percentile(unix_micros(ts), 0.55)")).first()[0]
    parts = [blocks.where(F.unix_micros("ts") <= marks), blocks.where(F.unix_micros("ts") > marks)]
    folder, root = shared_dir(spark, "split"), shared_dir(spark, "split-run")
    kind = parts[0].withColumn(rp.BEAT, F.lit(False))
    out = []
    for i, part in enumerate(parts):
        part.withColumn(rp.BEAT, F.lit(False)).coalesce(1).write.parquet(f"{folder}/_slice={i}")
        stream = rp.Slices(spark, folder, kind.schema, "ts", i).stream("1 minute")
        out.append(len(rows(rp.drain(ph.segment_stream(stream), "split", root=root).rows)))
    assert rows(sq.ad.rounded(spark.read.parquet(root + "/out"))) == want and 0 < out[0] < out[1] == len(want)


def test_gap_and_repeats(spark):
    # Block 7 never comes, blocks come twice and backwards.
    blocks = spark.range(0, 40).where("id <> 7").select(
        F.lit(1).cast("long").alias("device_id"), F.col("id").alias("block_idx"),
        F.timestamp_seconds(F.lit(1_000_000) + F.col("id")).alias("ts"), (F.col("id") < 20).alias("voiced"), F.lit(1.0).alias("energy"),
    )
    twice = blocks.withColumn("s", 3 - F.col("block_idx") % 4).unionByName(blocks.withColumn("s", 3 - F.col("block_idx") % 8).where("s >= 0"))
    stream = rp.stage(twice, F.col("s"), "ts", "gap").stream("1 hour").drop("s")
    out = rp.drain_whole(ph.segment_stream(stream), "gap").rows
    # Without block 7 the machine sees 39 blocks in a row.
    got = [(r["start_idx"], r["end_idx"], r["n_blocks"]) for r in out.collect()]
    dense = blocks.withColumn("block_idx", F.expr("if(block_idx > 7, block_idx - 1, block_idx)"))
    want = [(r["start_idx"], r["end_idx"] + 1, r["n_blocks"]) for r in sg.segment_phrases(dense).collect()]
    assert got == want and len(got) == 1


def test_short_delay_is_an_error(spark, shuffled):
    events = shuffled("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    # Slices against time.
    stream = rp.stage(events, 10 - F.floor(F.col("event_id") / 100), "ts", "short").stream("1 second")
    with pytest.raises(ValueError, match="behind the watermark"):
        rp.drain_whole(sq.tm.window_peaks(stream, "ts", ["event_type"], "value", "6 hours"), "short")


def test_late_rows_on_one_key(spark):
    rows_ = [(1, 0, 100), (1, 1, 200), (1, 2, 150), (1, 3, 60), (1, 4, None), (1, 5, 139), (1, 6, 140), (2, 7, 5)]
    df = spark.createDataFrame(rows_, "k int, n int, s long").withColumns({
        "at": F.timestamp_seconds("s"), "ts": F.timestamp_seconds(F.col("n").cast("long")),
    })
    stream = rp.stage(df, F.floor(F.col("n") / 3), "ts", "marks").stream("1 minute").select("k", "n", "at")
    got = rp.drain_whole(kd.mark_late(stream, "k", "n", "at", 60), "marks").rows
    assert sorted(r["n"] for r in got.where("late").collect()) == [3, 5] and got.count() == 8


def test_capture_ends(spark):
    import numpy as np

    rules = CaptureRules(start_timeout=5, end_silence=2, max_blocks=6)

    def ends(text, complete=True, at=None):
        at = np.arange(len(text)) if at is None else np.array(at)
        return capture_end(at, np.array([c == "1" for c in text], bool), rules, complete)

    assert ends("0000") == ("OPEN", None, None, None) and ends("0000", False) is None
    assert ends("00000", False) == ("NO_SPEECH", None, 4, None)
    assert ends("0111", False) is None and ends("0111") == ("OPEN", 3, None, None)
    assert ends("011100", False) == ("END_SILENCE", 3, 5, 5)
    assert ends("0111111111", False) == ("MAX_DURATION", 3, 6, 6)
    # A missing block keeps the end uncertain until nothing more can come.
    assert ends("01100", False, [0, 1, 2, 4, 5]) is None


def test_null_keys_and_times_keep_their_rows(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", 1), (1, None, 2), (None, "2024-01-02", 3), (None, None, 4), (1, "2024-01-03", 5)], "k int, ts string, v int"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    out = bucket_running(time_bucketed(df, "ts", "b"), ["k"], "b", ["ts", "v"], sums={"s": F.col("v")})
    assert sorted((r["v"], r["s"]) for r in out.collect()) == [(1, 3), (2, 2), (3, 7), (4, 4), (5, 8)]


def test_one_key_with_most_rows(spark):
    df = spark.range(2000).selectExpr(
        "if(id % 10 = 0, id, 7) AS k", "timestamp_seconds(id div 3) AS ts", "id AS v"
    )
    got = bucket_running(time_bucketed(df, "ts", "b", 50), ["k"], "b", ["ts", "v"], sums={"n": F.lit(1)})
    want = df.selectExpr("k", "v", "row_number() OVER (PARTITION BY k ORDER BY ts, v) AS n")
    assert rows(got.select("k", "v", F.col("n").cast("int"))) == rows(want)
    assert time_bucketed(df, "ts", "b", 50).where("k = 7").select("b").distinct().count() > 20
