"""Block streams and telemetry: windows, segmentation, latency and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.arrays import gigabytes
from voxloom.operators import segments as sg
from voxloom.operators import telemetry as tm
from voxloom.operators.ordered import time_bucketed
from voxloom.operators.phrase_machine import CaptureRules
from voxloom.plans import adapters as ad
from voxloom.plans.registry import query, with_ctes
from voxloom.session import shared_dir
from voxloom.sources import scans, sinks
from voxloom.streaming import keyed as kd, phrases as ph
from voxloom.streaming.replay import BEAT, drain, drain_whole, slices_by_time, stage


@query(
    "block_vote",
    """
    SELECT event_id // 5 AS block, count(*) FILTER (event_id % 37 <> 0) AS frames,
      round(coalesce(avg(CASE WHEN value >= 30 THEN 1.0 ELSE 0.0 END) FILTER (event_id % 37 <> 0), 0.0), 6) AS ratio,
      coalesce(avg(CASE WHEN value >= 30 THEN 1.0 ELSE 0.0 END) FILTER (event_id % 37 <> 0), 0.0) >= 0.6 AS voiced
    FROM events GROUP BY event_id // 5
    """,
)
def block_vote(t):
    frames = t("events").select(F.floor(F.col("event_id") / 5).alias("block"), "event_id", "value")
    return ad.rounded(sg.block_votes(frames, ["block"], F.col("value") >= 30, F.col("event_id") % 37 != 0))


@query(
    "onset_vote",
    with_ctes(
        ad.SQL_BLOCKS,
        """SELECT device_id, block_idx, sum(voiced::INT) OVER w AS votes, count(*) OVER w = 4 AND sum(voiced::INT) OVER w >= 3 AS onset
        FROM blocks WINDOW w AS (PARTITION BY device_id ORDER BY block_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    ).replace("sum(voiced::INT) OVER w AS votes", "(sum(voiced::INT) OVER w)::BIGINT AS votes"),
)
def onset_vote(t):
    return sg.onset_votes(ad.blocks(t)).select("device_id", "block_idx", "votes", "onset")


@query(
    "silence_run",
    with_ctes(
        ad.SQL_BLOCKS,
        """SELECT device_id, block_idx, block_idx - coalesce(max(CASE WHEN voiced THEN block_idx END) OVER w, -1) AS silent_blocks,
          round((block_idx - coalesce(max(CASE WHEN voiced THEN block_idx END) OVER w, -1)) * 0.1::DOUBLE, 6) AS silence_s
        FROM blocks WINDOW w AS (PARTITION BY device_id ORDER BY block_idx)""",
    ),
)
def silence_run(t):
    return ad.rounded(
        sg.silence_runs(ad.blocks(t)).select("device_id", "block_idx", "silent_blocks", "silence_s")
    )


@query(
    "pre_roll",
    with_ctes(
        ad.SQL_BLOCKS,
        """voted AS (SELECT *, count(*) OVER w = 4 AND sum(voiced::INT) OVER w >= 3 AS onset,
            min(block_idx) OVER p AS first_idx, count(*) OVER p AS n, sqrt(avg(energy) OVER p) AS rms
          FROM blocks WINDOW w AS (PARTITION BY device_id ORDER BY block_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
            p AS (PARTITION BY device_id ORDER BY block_idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""",
        "SELECT device_id, block_idx, first_idx, n, round(rms, 6) AS pre_roll_rms FROM voted WHERE onset",
    ),
)
def pre_roll(t):
    return ad.rounded(
        sg.pre_rolls(ad.blocks(t)).select(
            "device_id", "block_idx", F.get("pre_roll", F.lit(0)).alias("first_idx"),
            F.size("pre_roll").cast("long").alias("n"), "pre_roll_rms",
        )
    )


@query(
    "prefix_schedule",
    with_ctes(
        ad.SQL_BLOCKS,
        """ph AS (SELECT device_id, block_idx // 48 AS phrase_id, block_idx % 48 AS pos, value / 10000.0 AS amp FROM blocks),
        sizes AS (SELECT device_id, phrase_id, count(*) AS n FROM ph GROUP BY device_id, phrase_id),
        checks AS (SELECT device_id, phrase_id, m AS prefix, false AS is_final FROM sizes, (VALUES (15),(20),(25),(30),(35),(40)) v(m) WHERE n >= m
          UNION ALL SELECT device_id, phrase_id, least(n, 40), true FROM sizes WHERE n < 15 OR (n < 40 AND n % 5 <> 0))""",
        """SELECT c.device_id, c.phrase_id, c.prefix::BIGINT AS prefix, c.is_final, round(sqrt(sum(amp * amp) / c.prefix), 6) AS rms,
          sqrt(sum(amp * amp) / c.prefix) >= 0.008 AS submitted
        FROM checks c JOIN ph p ON p.device_id = c.device_id AND p.phrase_id = c.phrase_id AND p.pos < c.prefix GROUP BY c.device_id, c.phrase_id, c.prefix, c.is_final""",
    ),
)
def prefix_schedule(t):
    ph = ad.blocks(t).select(
        "device_id", F.floor(F.col("block_idx") / 48).alias("phrase_id"), (F.col("block_idx") % 48).alias("pos"),
        (F.col("value") / 10000.0 * (F.col("value") / 10000.0)).alias("energy"),
    )
    return ad.rounded(sg.prefix_schedule(ph, ["device_id", "phrase_id"], "pos", "energy"))


@query(
    "prefix_detected",
    with_ctes(
        ad.SQL_BLOCKS,
        """ph AS (SELECT device_id, block_idx // 48 AS phrase_id, block_idx % 48 AS pos, event_id FROM blocks),
        sizes AS (SELECT device_id, phrase_id, count(*) AS n, max(pos + 1) FILTER (event_id % 29 = 0) AS hit FROM ph GROUP BY device_id, phrase_id),
        checks AS (SELECT *, m AS prefix, false AS is_final FROM sizes, (VALUES (15),(20),(25),(30),(35),(40)) v(m) WHERE n >= m
          UNION ALL SELECT *, 0, least(n, 40), true FROM sizes WHERE n < 15 OR (n < 40 AND n % 5 <> 0))""",
        "SELECT device_id, phrase_id, prefix::BIGINT AS prefix, is_final FROM checks WHERE hit IS NULL OR prefix <= hit",
    ),
)
def prefix_detected(t):
    """Keyword checks that stop once the keyword was found."""
    pos = F.col("block_idx") % 48
    ph_ = ad.blocks(t).select(
        "device_id", F.floor(F.col("block_idx") / 48).alias("phrase_id"), pos.alias("pos"), "energy",
        F.when(F.col("event_id") % 29 == 0, pos + 1).alias("hit"),
    )
    return sg.prefix_schedule(ph_, ["device_id", "phrase_id"], "pos", "energy", detected_at="hit").select(
        "device_id", "phrase_id", "prefix", "is_final"
    )


@query(
    "noise_floor",
    with_ctes(
        ad.SQL_BLOCKS,
        """SELECT device_id, round(median(value / 10000.0), 9) AS noise_floor, round(greatest(0.008, 3 * median(value / 10000.0)), 9) AS threshold
        FROM blocks WHERE block_idx < 10 GROUP BY device_id""",
    ),
)
def noise_floor(t):
    calibration = ad.blocks(t).where("block_idx < 10").select("device_id", (F.col("value") / 10000.0).alias("rms"))
    return ad.rounded(sg.noise_thresholds(calibration, "device_id", "rms"), 9)


@query(
    "phrase_segments",
    with_ctes(
        ad.SQL_BLOCKS, ad.SQL_PHRASES,
        """SELECT device_id, start_idx, end_idx, start_ts, end_ts, n_blocks, round(duration_s, 6)::DOUBLE AS duration_s,
          round(rms, 6) AS rms, end_reason FROM phrases""",
    ),
)
def phrase_segments(t):
    return ad.rounded(sg.segment_phrases(ad.stored_blocks(t)))


@query(
    "phrase_segments_long",
    with_ctes(
        ad.sql_blocks("user_id % 4"), ad.SQL_PHRASES,
        """SELECT device_id, start_idx, end_idx, start_ts, end_ts, n_blocks, round(duration_s, 6)::DOUBLE AS duration_s,
          round(rms, 6) AS rms, end_reason FROM phrases""",
    ),
)
def phrase_segments_long(t):
    """Few long devices, small chunks and runs of chunks: the chaining path."""
    return ad.rounded(sg.segment_phrases(ad.stored_blocks(t, F.col("user_id") % 4), chunk=208, fan=3))


@query(
    "phrase_sessions",
    with_ctes(
        ad.SQL_BLOCKS,
        """gaps AS (SELECT *, coalesce(block_idx - lag(block_idx) OVER (PARTITION BY device_id ORDER BY block_idx) > 12, true) AS fresh FROM blocks WHERE voiced),
        ids AS (SELECT *, max(CASE WHEN fresh THEN block_idx END) OVER (PARTITION BY device_id ORDER BY block_idx) AS session_start FROM gaps)""",
        """SELECT device_id, session_start, max(block_idx) AS session_end, count(*) AS voiced_blocks, round(sqrt(avg(energy)), 6) AS rms
        FROM ids GROUP BY device_id, session_start""",
    ),
)
def phrase_sessions(t):
    return ad.rounded(sg.phrase_sessions(ad.stored_blocks(t)))


_CAPTURE_SQL = """
sessions AS (SELECT device_id, block_idx // 40 AS session, block_idx % 40 AS i, voiced::INT AS v FROM blocks),
cap AS (
  SELECT device_id, session, -1::BIGINT AS i, 0 AS run, -1 AS onset, 0 AS n, 0 AS sil, ''::VARCHAR AS stop
  FROM (SELECT DISTINCT device_id, session FROM sessions)
  UNION ALL
  SELECT device_id, session, i, run, onset, n, sil,
    CASE WHEN was >= 0 AND sil >= 6 THEN 'END_SILENCE' WHEN was >= 0 AND n >= 25 THEN 'MAX_DURATION'
         WHEN onset < 0 AND i + 1 >= 12 THEN 'NO_SPEECH' ELSE '' END AS stop
  FROM (
    SELECT device_id, session, i, run, was, CASE WHEN was >= 0 THEN was WHEN run >= 3 THEN i ELSE -1 END AS onset,
      CASE WHEN was >= 0 THEN was_n + 1 WHEN run >= 3 THEN least(i + 1, 3) ELSE 0 END AS n,
      CASE WHEN was >= 0 AND v = 0 THEN was_sil + 1 ELSE 0 END AS sil
    FROM (
      SELECT c.device_id, c.session, s.i, s.v, CASE WHEN s.v = 1 THEN c.run + 1 ELSE 0 END AS run,
        c.onset AS was, c.n AS was_n, c.sil AS was_sil
      FROM cap c JOIN sessions s ON s.device_id = c.device_id AND s.session = c.session AND s.i = c.i + 1 WHERE c.stop = ''))),
final AS (SELECT * FROM cap QUALIFY row_number() OVER (PARTITION BY device_id, session ORDER BY i DESC) = 1)"""


@query(
    "energy_segments",
    with_ctes(
        ad.SQL_BLOCKS, _CAPTURE_SQL,
        """SELECT device_id, session, CASE WHEN stop = '' THEN 'OPEN' ELSE stop END AS stop_reason,
          CASE WHEN onset >= 0 THEN onset::BIGINT END AS onset_idx, CASE WHEN stop <> '' THEN i END AS stop_idx,
          CASE WHEN stop IN ('END_SILENCE', 'MAX_DURATION') THEN (n - greatest(sil - 2, 0))::BIGINT END AS kept_blocks FROM final""",
    ),
)
def energy_segments(t):
    armed = ad.blocks(t).select(
        "device_id", F.floor(F.col("block_idx") / 40).alias("session"), (F.col("block_idx") % 40).alias("i"), "voiced"
    )
    return sg.energy_captures(
        armed, ["device_id", "session"], "i", "voiced", start_timeout=12, end_silence=6, max_blocks=25
    )


@query(
    "pause_gate",
    with_ctes(
        """rows AS (SELECT user_id AS device_id, event_id, ts, value,
            CASE event_type WHEN 'error' THEN 'pause' WHEN 'purchase' THEN 'resume' END AS control FROM events),
        states AS (SELECT *, last_value(control IGNORE NULLS) OVER w AS state, count(*) FILTER (control = 'resume') OVER w AS epoch
          FROM rows WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id))""",
        "SELECT device_id, event_id, epoch FROM states WHERE control IS NULL AND coalesce(state <> 'pause', true)",
    ),
)
def pause_gate(t):
    rows = t("events").select(
        F.col("user_id").alias("device_id"), "event_id", "ts",
        F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "purchase", "resume").alias("control"),
    )
    rows = time_bucketed(rows, "ts", "_span")
    return sg.gate_pauses(rows, "device_id", ["ts", "event_id"], "_span", "control").select(
        "device_id", "event_id", F.col("epoch").cast("long").alias("epoch")
    )


@query(
    "padded_replay",
    with_ctes(
        ad.SQL_BLOCKS,
        """padded AS (SELECT device_id, block_idx, voiced FROM blocks
          UNION ALL SELECT device_id, k - 10, false FROM (SELECT DISTINCT device_id FROM blocks), range(10) r(k)
          UNION ALL SELECT device_id, m + 1 + k, false FROM (SELECT device_id, max(block_idx) AS m FROM blocks GROUP BY device_id), range(20) r(k))""",
        "SELECT device_id, block_idx, voiced FROM padded",
    ),
)
def padded_replay(t):
    return sg.pad_recordings(ad.stored_blocks(t)).select("device_id", "block_idx", "voiced")


@query(
    "phase_latency",
    """SELECT event_type AS phase, count(*) AS n, max(value) AS max_seconds,
      (list_sort(list(value)))[count(*) // 2 + 1] AS median_seconds FROM events GROUP BY event_type""",
)
def phase_latency(t):
    return tm.phase_latency(t("events").select(F.col("event_type").alias("phase"), "value"), "phase", "value").select(
        "phase", "n", F.col("max_seconds"), "median_seconds"
    )


@query(
    "detector_summary",
    """
    SELECT count(*) FILTER (pos AND hit) AS detected, count(*) FILTER (pos) AS positives, count(*) FILTER (NOT pos AND hit) AS false_accepts,
      count(*) FILTER (NOT pos) AS negatives, max(delay) FILTER (pos AND hit) AS delay_max,
      (list_sort(list(delay) FILTER (pos AND hit)))[count(*) FILTER (pos AND hit) // 2 + 1] AS delay_median
    FROM (SELECT event_type IN ('purchase', 'signup') AS pos, value >= 30 AS hit, round(value / 100, 2) AS delay FROM events)
    """,
)
def detector_summary(t):
    return tm.detector_summary(
        t("events"), F.col("event_type").isin("purchase", "signup"), F.col("value") >= 30, F.round(F.col("value") / 100, 2)
    )


@query(
    "headroom",
    """
    SELECT event_id, value AS used_mb, round(512.0 - value, 6)::DOUBLE AS free_mb, round_even(value * 100.0::DOUBLE / 512.0, 1) AS used_percent,
      512.0 - value < 400 AS skip, round_even(value * 1048576 / 1073741824.0, 2) AS used_gb FROM events
    """,
)
def headroom(t):
    rows = t("events").select("event_id", F.col("value").alias("used_mb"), F.lit(512.0).alias("total_mb"))
    out = tm.headroom(rows, "used_mb", "total_mb", 400.0)
    return out.select(
        "event_id", "used_mb", F.round("free_mb", 6).alias("free_mb"), "used_percent", "skip",
        gigabytes(F.col("used_mb") * 1048576).alias("used_gb"),
    )


@query(
    "interval_peak",
    """
    WITH ops AS (SELECT event_id AS op_id, user_id, value AS before_mb, value * 0.9 AS after_mb, epoch_us(ts) AS s,
        epoch_us(ts) + (event_id % 5) * 21600000000 AS e FROM events WHERE event_type = 'purchase')
    SELECT op_id, max(x.value) AS sample_peak, greatest(any_value(before_mb), any_value(after_mb), max(x.value)) AS observed_peak
    FROM ops LEFT JOIN events x ON x.user_id = ops.user_id AND epoch_us(x.ts) BETWEEN s AND e GROUP BY op_id
    """,
)
def interval_peak(t):
    e = t("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    ops = e.where("event_type = 'purchase'").select(
        F.col("event_id").alias("op_id"), "user_id", F.col("value").alias("before_mb"), (F.col("value") * 0.9).alias("after_mb"),
        F.col("at").alias("start_at"), (F.col("at") + (F.col("event_id") % 5) * 21_600_000_000).alias("end_at"),
    )
    return tm.operation_peaks(e.select("user_id", "at", "value"), ops, "user_id", "before_mb", "after_mb").select(
        "op_id", "sample_peak", "observed_peak"
    )


@query(
    "stage_breakdown",
    """
    SELECT user_id AS request, round(coalesce(sum(value) FILTER (event_type = 'view'), 0.0), 4) AS evidence_s,
      round(coalesce(sum(value) FILTER (event_type = 'click'), 0.0), 4) AS resolver_s,
      round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0), 4) AS stt_s, round(sum(value), 4) AS total_s
    FROM events GROUP BY user_id
    """,
)
def stage_breakdown(t):
    stage = F.when(F.col("event_type") == "view", "evidence").when(F.col("event_type") == "click", "resolver").when(
        F.col("event_type") == "purchase", "stt"
    )
    spans = t("events").select(F.col("user_id").alias("request"), stage.alias("stage"), "value")
    return ad.rounded(tm.stage_breakdown(spans, "request", "stage", "value", ("evidence", "resolver", "stt")), 4)


@query(
    "cold_warm_delta",
    """
    WITH n AS (SELECT user_id, value, value * 2 AS used, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT user_id, max(value) FILTER (n = 1) AS cold_s, max(value) FILTER (n = 2) AS first_s, max(value) FILTER (n = 3) AS second_s,
      max(value) FILTER (n = 4) AS reload_s, max(used) FILTER (n = 1) AS baseline_mb,
      round(max(used) FILTER (n = 2) - max(used) FILTER (n = 1), 6) AS first_delta_mb,
      round(max(used) FILTER (n = 3) - max(used) FILTER (n = 1), 6) AS second_delta_mb,
      round(max(used) FILTER (n = 4) - max(used) FILTER (n = 1), 6) AS reload_delta_mb
    FROM n GROUP BY user_id
    """,
)
def cold_warm_delta(t):
    runs = t("events").select(
        "user_id", "ts", "event_id", "value", (F.col("value") * 2).alias("used"),
    )
    runs = time_bucketed(runs, "ts", "_span")
    return ad.rounded(tm.cold_warm(runs, "user_id", ["ts", "event_id"], "_span", "value", "used"))


@query(
    "repeat_spread",
    """
    SELECT user_id, k, count(*) AS runs, arg_min(value, (ts, event_id)) AS first_s, arg_max(value, (ts, event_id)) AS last_s,
      round(max(value) - min(value), 6) AS spread_s
    FROM (SELECT *, (props->>'$.k')::BIGINT % 10 AS k FROM events) GROUP BY user_id, k HAVING count(*) > 1
    """,
)
def repeat_spread(t):
    runs = t("events").select(
        "user_id", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k"), "ts", "event_id", "value"
    )
    return ad.rounded(tm.repeat_spread(runs, ["user_id", "k"], ["ts", "event_id"], "value"))


@query(
    "telemetry_window",
    """SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, max(value) AS peak, count(*) AS n
    FROM events GROUP BY ALL""",
)
def telemetry_window(t):
    return tm.window_peaks(t("events"), "ts", ["event_type"], "value", "6 hours")


# Batches of a replay. Slices follow time, so a delay of a minute loses nothing.
SLICES = 6
DELAY = "1 minute"


def _events(t):
    """The events with times as instants."""
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


def _staged(rows, label: str, slices: int = SLICES):
    return stage(rows, slices_by_time(rows, "ts", slices), "ts", label)


_LATE_SQL = """
    SELECT event_id, user_id, et AS event_time, coalesce(et < max(et) OVER (PARTITION BY user_id ORDER BY event_id
      ROWS UNBOUNDED PRECEDING) - INTERVAL '3 hours', false) AS late
    FROM (SELECT event_id, user_id, CASE WHEN event_id % 20 = 0 THEN ts - INTERVAL '30 hours' ELSE ts END AS et FROM events)
    """


@query("late_blocks", _LATE_SQL)
def late_blocks(t):
    """Late blocks of a finished recording, all at once."""
    event_time = F.when(F.col("event_id") % 20 == 0, F.col("ts") - F.expr("INTERVAL 30 HOURS")).otherwise(F.col("ts"))
    rows = t("events").select(
        "event_id", "user_id", event_time.alias("event_time"), F.floor(F.col("event_id") / 512).alias("_b")
    )
    return tm.late_rows(rows, ["user_id"], "_b", ["event_id"], "event_time", 3 * 3600).drop("_b")


@query("late_stream", _LATE_SQL)
def late_stream(t):
    """Blocks as they arrive, the late ones marked by their device's own low-water mark."""
    return late_replay(t)


def late_replay(t, slices: int = SLICES):
    shifted = F.when(F.col("event_id") % 20 == 0, F.col("ts") - F.expr("INTERVAL 30 HOURS")).otherwise(F.col("ts"))
    arrived = _staged(_events(t).select("event_id", "user_id", "ts", shifted.alias("event_time")), "late-blocks", slices)
    rows = arrived.stream(DELAY).select("event_id", "user_id", "event_time")
    out = drain_whole(kd.mark_late(rows, "user_id", "event_id", "event_time", 3 * 3600, arrived.lanes), "late-blocks").rows
    return out.withColumn("event_time", F.col("event_time").cast(dict(t("events").dtypes)["ts"]))


@query(
    "phrase_stream",
    with_ctes(
        """blocks AS (SELECT event_id // 1024 AS device_id, event_id % 1024 AS block_idx, ts,
            value >= CASE WHEN ((event_id % 1024) // 24) % 2 = 0 THEN 15.0 ELSE 120.0 END AS voiced, (value / 1000.0) ** 2 AS energy FROM events)""",
        ad.SQL_PHRASES,
        """SELECT device_id, start_idx, end_idx, start_ts, end_ts, n_blocks, round(duration_s, 6)::DOUBLE AS duration_s,
          round(rms, 6) AS rms, end_reason FROM phrases""",
    ),
)
def phrase_stream(t):
    """The events as a live stream: each thousand consecutive ones are a device."""
    return phrase_replay(t)


def phrase_replay(t, slices: int = SLICES):
    idx = F.col("event_id") % 1024
    blocks = _events(t).select(
        F.floor(F.col("event_id") / 1024).alias("device_id"), idx.alias("block_idx"), "ts",
        (F.col("value") >= F.when(F.floor(idx / 24) % 2 == 0, 15.0).otherwise(120.0)).alias("voiced"),
        F.pow(F.col("value") / 1000.0, F.lit(2.0)).alias("energy"),
    )
    out = drain_whole(ph.segment_stream(_staged(blocks, "blocks", slices).stream(DELAY)), "phrase-stream").rows
    kind = dict(t("events").dtypes)["ts"]
    return ad.rounded(out.withColumns({c: F.col(c).cast(kind) for c in ("start_ts", "end_ts")}))


@query(
    "telemetry_stream",
    """SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, max(value) AS peak, count(*) AS n
      FROM events GROUP BY 1, 2""",
)
def telemetry_stream(t):
    """All windows of the replayed table, each closed by the watermark that passes it."""
    out = telemetry_replay(t).rows
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "peak", "n")


def telemetry_replay(t, slices: int = SLICES):
    rows = _staged(_events(t).select("ts", "event_type", "value"), "samples", slices).stream(DELAY)
    return drain_whole(tm.window_peaks(rows, "ts", ["event_type"], "value", "6 hours"), "telemetry")


@query(
    "wake_delivery",
    """
    SELECT event_id AS phrase_id, user_id AS device_id, CASE WHEN value >= 50 THEN 'heard ' || event_id END AS wake_text,
      CASE WHEN value >= 50 THEN 'delivered' ELSE 'discarded' END AS outcome
    FROM events WHERE event_type = 'purchase'
    """,
)
def wake_delivery(t):
    """Phrases and wake decisions as two streams, matched within a minute.

    A phrase has two decisions; the earlier one counts, though the later comes
    first in the file.
    """
    return wake_replay(t).rows.select("phrase_id", "device_id", "wake_text", "outcome")


def wake_replay(t, slices: int = SLICES):
    staged = _staged(_events(t).select("event_id", "user_id", "ts", "event_type", "value"), "events", slices)
    purchase = F.when(F.col("end_ts").isNotNull(), (F.col("event_type") == "purchase") & ~F.col(BEAT))
    phrases = staged.stream().select(
        F.col("user_id").alias("device_id"), F.col("event_id").alias("phrase_id"), F.col("ts").alias("end_ts"), "event_type", BEAT
    ).withWatermark("end_ts", DELAY).where(purchase).drop("event_type", BEAT)
    decisions = staged.stream().select(
        F.col("user_id").alias("device_id"), F.col("event_id").alias("phrase_id"),
        (F.col("value") >= 50).alias("detected"), "ts", F.explode(F.array(F.lit(20), F.lit(0))).alias("later"),
    ).select(
        "device_id", "phrase_id", "detected", (F.col("ts") + F.make_interval(secs="later")).alias("ts"),
        F.concat(F.when(F.col("later") > 0, "again ").otherwise("heard "), "phrase_id").alias("wake_text"),
    ).withWatermark("ts", DELAY)
    return drain_whole(ph.deliver_confirmed(phrases, decisions, lanes=staged.lanes), "delivery", staged.partitions)


# The watermark of a batch is that of two batches before, in milliseconds.
LATE_SLICES = 8


@query(
    "drop_late",
    f"""
    WITH shifted AS (SELECT event_id, user_id, CASE WHEN event_id % 20 = 0 THEN ts - INTERVAL '6 days' ELSE ts END AS ts,
        event_id * {LATE_SLICES} // (max(event_id) OVER () + 1) AS batch FROM events),
    marks AS (SELECT batch, (max(max(epoch_us(ts)) // 1000) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) - 10800000) * 1000 AS mark
      FROM shifted GROUP BY batch),
    judged AS (SELECT s.*, coalesce(epoch_us(s.ts) <= m.mark, false) AS dropped FROM shifted s LEFT JOIN marks m ON m.batch = s.batch - 2)
    SELECT event_id, user_id, ts, (SELECT count(*) * 2 FROM judged WHERE dropped) AS dropped FROM judged WHERE NOT dropped
    """,
)
def drop_late(t):
    """Repeated blocks once each, with the number of rows dropped as late.

    Every twentieth block comes six days late, behind a watermark of three hours.
    """
    return drop_late_replay(t)


def drop_late_replay(t):
    shifted = F.when(F.col("event_id") % 20 == 0, F.col("ts") - F.expr("INTERVAL 6 DAYS")).otherwise(F.col("ts"))
    rows = _events(t).select("event_id", "user_id", shifted.alias("ts"))
    last = t("events").agg(F.max("event_id").alias("last"))
    rows = rows.join(F.broadcast(last)).withColumn(
        "_batch", F.floor(F.col("event_id") * LATE_SLICES / (F.col("last") + 1))
    ).drop("last")
    staged = stage(rows, F.col("_batch"), "ts", "late")
    twice = staged.stream("3 hours").select("event_id", "user_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    done = drain(ph.drop_late(twice, ["event_id"]).drop("copy"), "late")
    kind = dict(t("events").dtypes)["ts"]
    return done.rows.withColumns({"ts": F.col("ts").cast(kind), "dropped": F.lit(done.late).cast("long")})


@query(
    "pause_stream",
    with_ctes(
        """rows AS (SELECT user_id AS device_id, event_id, ts, value,
            CASE event_type WHEN 'error' THEN 'pause' WHEN 'purchase' THEN 'resume' END AS control FROM events),
        states AS (SELECT *, last_value(control IGNORE NULLS) OVER w AS state, count(*) FILTER (control = 'resume') OVER w AS epoch
          FROM rows WINDOW w AS (PARTITION BY device_id ORDER BY ts, event_id))""",
        "SELECT device_id, event_id, epoch FROM states WHERE control IS NULL AND coalesce(state <> 'pause', true)",
    ),
)
def pause_stream(t):
    """Pauses and resumes inside the stream: control rows among the blocks."""
    return pause_replay(t)


def pause_replay(t, slices: int = SLICES):
    rows = _events(t).select(
        F.col("user_id").alias("device_id"), "event_id", "ts",
        F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "purchase", "resume").alias("control"),
    )
    staged = _staged(rows, "controls", slices)
    gated = kd.gate_pauses_stream(staged.stream(DELAY), "device_id", ["ts", "event_id"], "control", staged.lanes)
    return drain_whole(gated, "pauses").rows.select("device_id", "event_id", "epoch")


@query(
    "capture_stream",
    with_ctes(
        ad.SQL_BLOCKS, _CAPTURE_SQL,
        """SELECT device_id, session, CASE WHEN stop = '' THEN 'OPEN' ELSE stop END AS stop_reason,
          CASE WHEN onset >= 0 THEN onset::BIGINT END AS onset_idx, CASE WHEN stop <> '' THEN i END AS stop_idx,
          CASE WHEN stop IN ('END_SILENCE', 'MAX_DURATION') THEN (n - greatest(sil - 2, 0))::BIGINT END AS kept_blocks FROM final""",
    ),
)
def capture_stream(t):
    """Armed captures of a live stream; timers close sessions whose blocks stop."""
    return capture_replay(t).rows


def capture_replay(t, slices: int = SLICES):
    armed = ad.stored_blocks(t).select(
        "device_id", F.floor(F.col("block_idx") / 40).alias("session"), (F.col("block_idx") % 40).alias("i"), "voiced",
        F.col("ts").cast("timestamp").alias("ts"),
    )
    # Blocks of a device lie hours apart in this table; a session idle for ten days is over.
    staged = stage(armed, slices_by_time(armed, "ts", slices), "ts", "armed", idle="11 days")
    rules = CaptureRules(start_timeout=12, end_silence=6, max_blocks=25)
    return drain_whole(
        kd.capture_stream(
            staged.stream(DELAY), ["device_id", "session"], "i", "voiced", "ts", rules, idle_s=10 * 86400, lanes=staged.lanes
        ),
        "captures",
    )


@query("journal_stream", with_ctes(ad.SQL_JOURNAL, "SELECT event, status, count(*) AS n, count(DISTINCT attempt_id) AS attempts FROM journal GROUP BY event, status"))
def journal_stream(t):
    """Journal events as they come, each batch once in the journal, then a scan of it."""
    events = ad.journal(t).select("event", "attempt_id", "status", F.col("ts").cast("timestamp").alias("ts"))
    root = shared_dir(t.spark, "live-journal")
    sinks.stream_journal(_staged(events, "live-events").stream(DELAY).drop("ts"), f"{root}/journal", f"{root}/checkpoint")
    return scans.read_journal(t.spark, f"{root}/journal", pattern="*.json").groupBy("event", "status").agg(
        F.count("*").alias("n"), F.count_distinct("attempt_id").alias("attempts")
    )
