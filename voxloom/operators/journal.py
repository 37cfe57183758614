"""Folding event journals and result runs into evaluation corpora."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.operators.contracts import violation_list
from voxloom.operators.ordered import bucket_running
from voxloom.session import parallelism

# Bands of a lookup table at most: every task holds them.
BANDS = 1 << 20


def fold_journal(events: DataFrame, order: Sequence[str] = ("file", "line")) -> DataFrame:
    """Accepted cases: the last attempt, capture and review event of each attempt.

    One mergeable aggregation instead of three sorted joins. Violations are
    kept per case: missing pieces, blank reference, several accepted
    recordings of one prompt.
    """
    rank = F.struct(*order)

    def last(kind: str, fields: Sequence[str], alias: str) -> Column:
        return F.max_by(
            F.struct(*fields), F.when(F.col("event") == kind, rank)
        ).alias(alias)

    # max_by keeps a null ordering only when no other exists, so a kind that
    # never occurred is recognised by its own count.
    folded = events.groupBy("attempt_id").agg(
        last("attempt", ["prompt_id", "speech_label"], "_a"),
        last("captured", ["filename", "sha256", *(["file"] if "file" in events.columns else [])], "_c"),
        last("review", ["status", "reference_text"], "_r"),
        F.count_if(F.col("event") == "attempt").alias("_na"),
        F.count_if(F.col("event") == "captured").alias("_nc"),
        F.count_if(F.col("event") == "review").alias("_nr"),
    )
    accepted = folded.where((F.col("_nr") > 0) & (F.col("_r.status") == "accepted")).select(
        "attempt_id",
        F.when(F.col("_na") > 0, F.col("_a.prompt_id")).alias("prompt_id"),
        F.when(F.col("_na") > 0, F.col("_a.speech_label")).alias("speech_label"),
        F.when(F.col("_nc") > 0, F.col("_c.filename")).alias("filename"),
        F.when(F.col("_nc") > 0, F.col("_c.sha256")).alias("sha256"),
        *([F.when(F.col("_nc") > 0, F.col("_c.file")).alias("manifest")] if "file" in events.columns else []),
        F.col("_r.reference_text").alias("reference_text"),
        ((F.col("_na") == 0) | (F.col("_nc") == 0)).alias("_incomplete"),
    )
    several = (
        accepted.where("prompt_id IS NOT NULL").groupBy("prompt_id").count().where("count > 1")
        .select(F.col("prompt_id").alias("_p"))
    )
    joined = accepted.join(several, F.col("prompt_id") == F.col("_p"), "left")
    return joined.select(
        "attempt_id",
        "prompt_id",
        "speech_label",
        "filename",
        "sha256",
        *(["manifest"] if "manifest" in accepted.columns else []),
        "reference_text",
        violation_list(
            (F.col("_incomplete"), "incomplete_attempt"),
            (F.trim(F.coalesce("reference_text", F.lit(""))) == "", "missing_reference"),
            (F.col("_p").isNotNull(), "several_accepted"),
        ).alias("violations"),
    )


def fold_verified(events: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``fold_journal`` with the content check: a listed recording must lie
    below ``root``, exist in the folder of its manifest and have its digest.

    ``events`` come from ``scans.read_journal``, ``files`` from
    ``scans.catalog_files``. What fails is kept with its violations.
    """
    from voxloom.sources.scans import verify_files

    cases = fold_journal(events)
    checked = verify_files(cases, files, manifest="manifest", root=root)
    return checked.withColumn(
        "violations",
        F.when(F.col("violation").isNull() | F.array_contains("violations", "incomplete_attempt"), F.col("violations"))
        .otherwise(F.concat("violations", F.array("violation"))),
    ).drop("violation")


def first_accepted(
    events: DataFrame, file: str = "file", line: str = "line", lines_per_bucket: int = 100_000
) -> DataFrame:
    """Earliest accepted recording per prompt over files in order.

    A review counts only when its attempt and capture came earlier in the same
    file; the values in force at that line are the latest earlier ones.
    """
    bucketed = events.withColumn("_b", F.floor(F.col(line) / lines_per_bucket))
    running = bucket_running(
        bucketed,
        [file, "attempt_id"],
        "_b",
        [line],
        lasts={
            "_prompt": F.when(F.col("event") == "attempt", F.col("prompt_id")),
            "_audio": F.when(F.col("event") == "captured", F.col("filename")),
        },
    )
    hits = running.where(
        (F.col("event") == "review") & (F.col("status") == "accepted")
        & F.col("_prompt").isNotNull() & F.col("_audio").isNotNull()
    )
    return hits.groupBy(F.col("_prompt").alias("prompt_id")).agg(
        F.min_by(
            F.struct("attempt_id", F.col("_audio").alias("filename"), "reference_text"),
            F.struct(file, line),
        ).alias("c")
    ).select("prompt_id", "c.*")


GUARDED = ("sha256", "attempt_id", "reference_text")


def one_per_key(df: DataFrame, key: str, copies: str = "copies") -> DataFrame:
    """One row per key with the number of copies.

    Copies are combined before the shuffle that a join on the key needs
    anyway, so a key with very many copies on both sides of a join cannot
    multiply.
    """
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(
        F.min(F.struct(*others)).alias("_row"), F.count(F.lit(1)).alias(copies)
    ).select(key, "_row.*", copies)


def paired_compare(baseline: DataFrame, other: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Two runs side by side; rows that are not about the same audio are flagged."""
    b, o = one_per_key(baseline, key), one_per_key(other, key)
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    o = o.select(*[F.col(c).alias(f"o_{c}") for c in o.columns])
    joined = b.join(o, F.col(f"b_{key}") == F.col(f"o_{key}"))
    checks = [
        ((F.col("b_copies") > 1) | (F.col("o_copies") > 1), "duplicate_id"),
        (F.col("b_status") != "ok", "baseline_failed"),
        (F.col("o_status") != "ok", "run_failed"),
    ]
    checks += [
        (~F.col(f"b_{f}").eqNullSafe(F.col(f"o_{f}")), f"{f}_mismatch") for f in GUARDED
    ]
    return joined.withColumn("violations", violation_list(*checks)).drop("b_copies", "o_copies")


def coverage_diff(expected: DataFrame, actual: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Missing and extra keys, then keys that differ or repeat; equal keys are left out."""
    e, a = (one_per_key(df.select(key, *fields), key) for df in (expected, actual))
    e = e.select(*[F.col(c).alias(f"_e_{c}") for c in e.columns])
    a = a.select(*[F.col(c).alias(f"_a_{c}") for c in a.columns])
    left, right = F.col(f"_e_{key}"), F.col(f"_a_{key}")
    joined = e.join(a, left == right, "full")
    repeated = (F.col("_e_copies") > 1) | (F.col("_a_copies") > 1)
    differing = violation_list(*[
        (~F.col(f"_e_{f}").eqNullSafe(F.col(f"_a_{f}")), f) for f in fields
    ])
    return joined.select(
        F.coalesce(left, right).alias(key),
        F.when(right.isNull(), "missing")
        .when(left.isNull(), "extra")
        .when(repeated, "duplicate")
        .when(F.size(differing) > 0, "mismatch")
        .alias("kind"),
        F.when(right.isNotNull() & left.isNotNull(), F.array_join(differing, ",")).alias("fields"),
    ).where("kind IS NOT NULL")


# Rows of both key lists that a task of the reconciliation gets.
RECONCILED = 1 << 20


def reconcile_keys(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys in one table only, once each; a null key is in neither other table.

    Both sides meet in one shuffle, whose tasks grow in number with the rows, so
    that a task's hash table does not.
    """
    both = listed.select(key, F.lit(True).alias("_l")).unionByName(present.select(key, F.lit(False).alias("_l")))
    tasks = max(parallelism(both.sparkSession), -(-both.count() // RECONCILED))
    sides = both.repartition(tasks, key).groupBy(key).agg(F.bool_or("_l").alias("_in"), F.bool_or(~F.col("_l")).alias("_out"))
    alone = ~(F.col("_in") & F.col("_out")) | F.col(key).isNull()
    side = F.array_compact(F.array(F.when(F.col("_in"), "listed_only"), F.when(F.col("_out"), "present_only")))
    return sides.where(alone).select(key, F.explode(side).alias("side"))


def check_cases(results: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Case rows of a result file with their violations.

    A result without any case row is an error: there is nothing to flag it on.
    """
    from voxloom.operators.contracts import flag_duplicates

    rows = results.where(F.col("event") == "case")
    if rows.isEmpty():
        raise ValueError("no cases in the results")
    cases = flag_duplicates(rows, [key], "_dup")
    return cases.withColumn(
        "violations",
        violation_list(
            (~F.col("status").eqNullSafe("ok"), "failed_case"),
            (F.col("_dup"), "duplicate_case"),
            (F.coalesce("sha256", F.lit("")) == "", "missing_sha256"),
            (F.col("text").isNull(), "missing_text"),
        ),
    ).drop("_dup")


def gather_alternatives(
    baseline: DataFrame, alternatives: dict[str, DataFrame], key: str = "prompt_id"
) -> DataFrame:
    """Baseline cases with the sources and texts that offer an alternative.

    Sources are a fixed list, so one conditional aggregation per source keeps
    every group bounded. Rows without a baseline, about other audio, or with
    an id that a source has twice are kept and flagged.
    """
    names = list(alternatives)
    cols = [key, "text", *GUARDED]
    parts = [baseline.select(*cols, F.lit(-1).alias("_src"))] + [
        alternatives[n].select(*cols, F.lit(i).alias("_src")) for i, n in enumerate(names)
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)

    # One whole row per source: the fields of one answer never mix with another's.
    aggs = []
    for i in range(-1, len(names)):
        mine = F.col("_src") == i
        aggs += [
            F.count_if(mine).alias(f"_n{i}" if i >= 0 else "_base"),
            F.min(F.when(mine, F.struct("text", *GUARDED))).alias(f"_r{i}" if i >= 0 else "_r"),
        ]
    folded = union.groupBy(key).agg(*aggs)
    wide = folded.select(
        "*", "_r.*",
        *[F.col(f"_r{i}.text").alias(f"_t{i}") for i in range(len(names))],
        *[F.col(f"_r{i}.{f}").alias(f"_{f}{i}") for i in range(len(names)) for f in GUARDED],
    )
    twice = F.col("_base") > 1
    for i in range(len(names)):
        twice = twice | (F.col(f"_n{i}") > 1)
    here = [F.col(f"_n{i}") > 0 for i in range(len(names))]
    mismatch = F.lit(False)
    for i in range(len(names)):
        for f in GUARDED:
            mismatch = mismatch | (here[i] & ~F.col(f"_{f}{i}").eqNullSafe(F.col(f)))
    return wide.select(
        key,
        "text",
        *GUARDED,
        F.array_compact(F.array(*[F.when(h, n) for h, n in zip(here, names)])).alias("sources"),
        F.array_compact(F.array(*[F.when(h, F.col(f"_t{i}")) for i, h in enumerate(here)])).alias("texts"),
        violation_list(
            (F.col("_base") == 0, "not_in_baseline"),
            ((F.col("_base") > 0) & mismatch, "audio_mismatch"),
            (twice, "duplicate_id"),
        ).alias("violations"),
    )


def correlate_wake(phrases: DataFrame, results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Each phrase with its first positive wake decision.

    Decisions for unknown phrases drop out; a finished phrase is delivered
    when any decision was positive and discarded otherwise.
    """
    keys = list(keys)
    decided = results.groupBy(*keys).agg(
        F.count("*").alias("checks"),
        F.bool_or("detected").alias("_hit"),
        F.min_by("wake_text", F.when(F.col("detected"), F.col(order))).alias("_text"),
    )
    hit = F.coalesce("_hit", F.lit(False))
    return phrases.join(decided, keys, "left").select(
        *phrases.columns,
        F.coalesce("checks", F.lit(0)).alias("checks"),
        hit.alias("wake_detected"),
        F.when(hit, F.col("_text")).alias("wake_text"),
        F.when(F.col("finished") & hit, "delivered")
        .when(F.col("finished"), "discarded")
        .otherwise("open")
        .alias("outcome"),
    )


def assign_bands(number: Column, bands: Sequence[tuple[int, int, str]]) -> Column:
    """Label of the numeric band a value falls into, null outside all bands."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(bands)):
        out = F.when((number >= low) & (number <= high), label).otherwise(out)
    return out


def band_lookup(rows: DataFrame, number: str, bands: DataFrame, out: str = "track") -> tuple[DataFrame, DataFrame]:
    """Rows with the label of the band their number lies in, and the rows without one.

    ``bands`` has (low, high, label), both ends included. Bands must not
    overlap; then they are sorted by their ends alike, the band of a number is
    the last one that starts at or below it, and one binary search finds it.
    The table is held as arrays by every task, so it is counted first; a
    null number, or one in a gap, goes to the second frame.
    """
    table = bands.select("low", "high", "label").orderBy("low").limit(BANDS + 1).toArrow()
    if table.num_rows > BANDS:
        raise ValueError(f"more than {BANDS} bands")
    low, high = (table.column(c).to_numpy().astype("int64") for c in ("low", "high"))
    if (low > high).any() or (low[1:] <= high[:-1]).any():
        raise ValueError("bands overlap or end before they start")
    label = table.column("label").to_numpy(zero_copy_only=False)

    @F.pandas_udf("string")
    def search(v: pd.Series) -> pd.Series:
        known = v.notna().to_numpy()
        at = v.fillna(0).to_numpy("int64")
        k = np.searchsorted(low, at, "right") - 1
        hit = known & (k >= 0) & (at <= high[k] if len(high) else known)
        return pd.Series(np.where(hit, label[k], None) if len(label) else [None] * len(v), dtype=object)

    found = rows.withColumn(out, search(F.col(number).cast("long")))
    return found.where(F.col(out).isNotNull()), found.where(F.col(out).isNull()).drop(out)


def resume_slice(df: DataFrame, key: str, start, count: int) -> DataFrame:
    """``count`` rows from ``start`` on, in key order."""
    if count < 0:
        raise ValueError("count must not be negative")
    return df.where(F.col(key) >= start).orderBy(key).limit(count)


def merge_labels(recordings: DataFrame, existing: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """Recordings with a label: a new one, else the stored non-empty one."""
    def stored(df: DataFrame, out: str) -> DataFrame:
        # A recording listed twice counts once.
        return df.groupBy(key).agg(F.max(F.nullif(F.trim(F.col(label)), F.lit(""))).alias(out))

    old, fresh = stored(existing, "_old"), stored(new, "_new")
    return (
        recordings.select(key).join(old, key, "left").join(fresh, key, "left")
        .select(key, F.coalesce("_new", "_old").alias(label))
        .where(F.col(label).isNotNull())
    )
