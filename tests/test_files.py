"""Files through digests, reports with provenance, quarantine, bands, sketches, plans."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import contracts as ct
from voxloom.operators import evaluate as va
from voxloom.operators import journal as jn
from voxloom.sources import scans, sinks

CONTENTS = {
    "empty.bin": b"", "one.bin": b"\n", "two.bin": b"\n\n", "open.bin": b"a\nb", "closed.bin": b"a\nb\n", "windows.bin": b"a\r\nb\r\n\r",
    "bytes.bin": bytes(range(256)) * 3, "invalid.bin": b"\xff\xfe\n\x80\n\xf0\x9f", "nul.bin": b"\0\n\0", "long.bin": b"x" * 3_000_000,
}


def test_digests_of_files(spark, tmp_path):
    rng = random.Random(1)
    contents = {**CONTENTS, "random.bin": rng.randbytes(700_000), "lines.bin": b"".join(b"%d\n" % i for i in range(200_000))}
    for i, (name, data) in enumerate(contents.items()):
        folder = tmp_path / f"s{i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(data)
    (tmp_path / "s0" / "other.txt").write_bytes(b"not asked for")
    # Small splits: a file is read by several tasks and still hashed in order.
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = scans.digest_files(spark, str(tmp_path), "*.bin").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["path"].split("/")[-1]: (r["bytes"], r["sha256"]) for r in got} == {
        k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in contents.items() if v
    }


def test_report_names_its_inputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("b.jsonl", b"two\n"), ("a.jsonl", b"one")):
        (tmp_path / "in" / name).write_bytes(data)
    cases = spark.createDataFrame([("p1", "ok"), ("p2", "bad")], "prompt_id string, status string")
    report = sinks.report_envelope(cases, "status", scans.digest_files(spark, str(tmp_path / "in")))
    sinks.write_report(report, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        sinks.write_report(report, str(tmp_path / "out"))
    rows = {r["event"]: r for r in spark.read.json(str(tmp_path / "out")).collect() if r["event"] != "case"}
    want = ",".join(f'{{"name":"{n}","sha256":"{hashlib.sha256(d).hexdigest()}"}}' for n, d in (("a.jsonl", b"one"), ("b.jsonl", b"two\n")))
    assert rows["start"]["inputs"] == f"[{want}]" and rows["end"]["inputs"] is None
    assert (rows["end"]["completed"], rows["end"]["failed"]) == (1, 1)


def test_quarantine_in_one_pass(spark, tmp_path):
    rows = spark.range(100).withColumn("violations", ct.violation_list((F.col("id") % 5 == 0, "five"), (F.col("id") % 10 == 0, "ten")))
    good, bad, counts = sinks.write_quarantined(rows, str(tmp_path / "q"))
    assert counts == {"rows": 100, "bad": 20, "violations": 30}
    assert good.count() == 80 and sorted(r["id"] for r in bad.collect()) == list(range(0, 100, 5))
    assert bad.columns == rows.columns and ct.enforce(good, strict=True).count() == 80
    with pytest.raises(Exception, match="contract broken"):
        ct.enforce(bad, strict=True).collect()
    good, bad, counts = sinks.write_quarantined(rows.limit(0), str(tmp_path / "none"))
    assert good.count() == bad.count() == 0 and counts["rows"] == 0


def test_bands_from_a_table(spark):
    bands = [(30, 39, "c"), (1, 10, "a"), (11, 11, "b"), (-5, -2, "z")]
    rows = spark.createDataFrame([(i,) for i in range(-8, 45)] + [(None,)], "n long")
    found, rest = jn.band_lookup(rows, "n", spark.createDataFrame(bands, "low long, high long, label string"))
    want = {i: lab for low, high, lab in bands for i in range(low, high + 1)}
    assert {r["n"]: r["track"] for r in found.collect()} == want
    assert sorted((r["n"] for r in rest.collect()), key=str) == sorted(([i for i in range(-8, 45) if i not in want] + [None]), key=str)
    for wrong in ([(1, 5, "a"), (5, 6, "b")], [(4, 3, "a")]):
        with pytest.raises(ValueError, match="overlap"):
            jn.band_lookup(rows, "n", spark.createDataFrame(wrong, "low long, high long, label string"))
    found, rest = jn.band_lookup(rows, "n", spark.createDataFrame([], "low long, high long, label string"))
    assert found.count() == 0 and rest.count() == 54


def test_sketches_merge(spark):
    rng = random.Random(3)
    rows = [(i % 7, rng.gauss(0, 1) if i % 3 else 5.0) for i in range(30_000)]
    df = spark.createDataFrame(rows, "part int, v double")
    stored = va.quantile_sketches(df, ["part"], "v")
    got = va.sketched_summary(stored.withColumn("span", F.col("part") < 4), ["span"], {"p10": 0.1, "p90": 0.9}).collect()
    for r in got:
        own = sorted(v for p, v in rows if (p < 4) == r["span"])
        assert r["n"] == len(own)
        for name, f in (("p10", 0.1), ("p90", 0.9)):
            low = sum(v < r[name] for v in own) / len(own)
            high = sum(v <= r[name] for v in own) / len(own)
            assert low - 0.01 <= f <= high + 0.01


def test_plan_cycles_through_phrases(spark):
    phrases = spark.createDataFrame([("bg", 0, "x"), ("bg", 1, "y"), ("en", 0, "z")], "language string, slot long, phrase string")
    got = sorted(map(tuple, scans.round_robin_plan(phrases, 5).collect()))
    assert got == [("bg", i, "xy"[i % 2]) for i in range(5)] + [("en", i, "z") for i in range(5)]
    assert scans.round_robin_plan(phrases.limit(0), 5).count() == 0


def test_batches_are_in_the_journal_once(spark, tmp_path):
    root = str(tmp_path / "journal")
    rows = spark.range(10).selectExpr("'review' AS event", "concat('a', id) AS attempt_id")
    sinks.append_batch(rows.limit(6), 0, root)
    sinks.append_batch(rows.where("attempt_id > 'a5'"), 1, root)
    # The same batch again, and one that fails on its way.
    sinks.append_batch(rows.where("attempt_id > 'a5'"), 1, root)
    with pytest.raises(Exception, match="on the way"):
        sinks.append_batch(rows.withColumn("status", F.when(F.col("attempt_id") == "a9", F.raise_error(F.lit("on the way"))).otherwise("x")), 2, root)
    got = sorted(r["attempt_id"] for r in scans.read_journal(spark, root, pattern="*.json").collect())
    assert got == [f"a{i}" for i in range(10)]
