import hashlib
import json

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from voxloom import schemas
from voxloom.operators import contracts as ct
from voxloom.operators import journal as jn
from voxloom.operators import transcripts as tr
from voxloom.sources import scans, sinks


def write_journal(folder, events):
    folder.mkdir(parents=True)
    (folder / "manifest.jsonl").write_text("\n".join(json.dumps(e) for e in events), encoding="utf-8")


def recording(tmp_path, *, status="accepted", later=None, session="s1", attempt="a1"):
    folder = tmp_path / "data" / session
    audio = f"RIFF-some-bytes of {session}".encode()
    events = [
        {"event": "session"},
        {"event": "attempt", "attempt_id": attempt, "prompt_id": f"BG-{session}", "speech_label": "BG"},
        {"event": "captured", "attempt_id": attempt, "filename": "a1.wav", "sha256": hashlib.sha256(audio).hexdigest()},
        {"event": "review", "attempt_id": attempt, "status": status, "reference_text": "спри"},
    ]
    if later:
        events.append({"event": "review", "attempt_id": attempt, "status": later})
    write_journal(folder, events)
    (folder / "a1.wav").write_bytes(audio)
    return tmp_path / "data"


def verified(spark, root):
    files = scans.catalog_files(spark, str(root))
    rows = jn.fold_verified(scans.read_journal(spark, str(root)), files, str(root)).collect()
    return {r["attempt_id"]: r["violations"] for r in rows}


def test_accepted_case_and_content(spark, tmp_path):
    recording(tmp_path, session="s2", attempt="a2")
    root = recording(tmp_path)
    # Two sessions with one file name do not mix.
    assert verified(spark, root) == {"a1": [], "a2": []}
    (root / "s1" / "a1.wav").write_bytes(b"other")
    assert verified(spark, root) == {"a1": ["digest_mismatch"], "a2": []}
    (root / "s1" / "a1.wav").unlink()
    assert verified(spark, root) == {"a1": ["missing_file"], "a2": []}


def test_file_outside_the_root(spark, tmp_path):
    root = recording(tmp_path)
    path = root / "s1" / "manifest.jsonl"
    path.write_text(path.read_text(encoding="utf-8").replace("a1.wav", "../../a1.wav"), encoding="utf-8")
    (tmp_path / "a1.wav").write_bytes(b"RIFF-some-bytes of s1")
    assert verified(spark, root) == {"a1": ["outside_root"]}


def test_order_is_the_files(spark, tmp_path):
    events = [{"event": "review", "attempt_id": f"a{i % 50}", "status": "rejected" if i < 1950 else "accepted",
               "reference_text": f"t{i}", "line": 5000 - i} for i in range(2000)]
    write_journal(tmp_path / "s", events)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many blocks of one file
    try:
        journal = scans.read_journal(spark, str(tmp_path))
        assert journal.rdd.getNumPartitions() > 5
        rows = journal.repartition(7).orderBy("line").collect()
        assert [r["reference_text"] for r in rows] == [f"t{i}" for i in range(2000)]
        assert jn.fold_journal(journal.repartition(3)).count() == 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_later_rejection_wins(spark, tmp_path):
    root = recording(tmp_path, later="rejected")
    assert jn.fold_journal(scans.read_journal(spark, str(root))).count() == 0


def test_first_accepted_needs_an_earlier_capture(spark):
    rows = [
        ("f1", 1, "attempt", "a", "P", None, None), ("f1", 2, "review", "a", None, None, "accepted"),
        ("f1", 3, "captured", "a", None, "one.wav", None), ("f1", 4, "captured", "a", None, "two.wav", None),
        ("f1", 5, "review", "a", None, None, "accepted"), ("f2", 1, "attempt", "b", "P", None, None),
        ("f2", 2, "captured", "b", None, "late.wav", None), ("f2", 3, "review", "b", None, None, "accepted"),
    ]
    df = spark.createDataFrame(
        rows, "file string, line long, event string, attempt_id string, prompt_id string, filename string, status string"
    ).withColumn("reference_text", F.lit("r"))
    got = jn.first_accepted(df, lines_per_bucket=2).collect()
    assert [(r["prompt_id"], r["filename"]) for r in got] == [("P", "two.wav")]


def test_strict_contract_fails_the_job(spark):
    df = spark.createDataFrame([("a.wav", "BG", "x"), ("a.wav", "XX", " "), ("", "EN", "y")], "f string, l string, t string")
    checked = ct.validate_manifest(df, "f", "l", "t")
    got = sorted(",".join(r["violations"]) for r in checked.collect())
    assert got == ["duplicate_filename", "duplicate_filename,invalid_label,missing_text", "missing_filename"]
    with pytest.raises(PySparkException):
        ct.enforce(checked, strict=True).collect()
    good = ct.validate_manifest(df.limit(1), "f", "l", "t")
    assert ct.enforce(good, strict=True).count() == 1


def test_journal_append_and_exclusive_report(spark, tmp_path):
    root = str(tmp_path / "j")
    events = spark.createDataFrame([("attempt", "a")], "event string, attempt_id string")
    sinks.append_journal(events, root)
    sinks.append_journal(events, root)
    assert spark.read.json(root).count() == 2
    cases = spark.createDataFrame([("1", "ok"), ("2", "error")], "prompt_id string, status string")
    report = sinks.report_envelope(cases, "status")
    end = report.where("event = 'end'").first()
    assert (end["completed"], end["failed"]) == (1, 1)
    digest = report.where("event = 'start'").first()["inputs_digest"]
    again = sinks.report_envelope(cases.orderBy(F.desc("prompt_id")), "status").where("event = 'start'").first()
    assert digest == again["inputs_digest"]
    double = sinks.report_envelope(cases.unionByName(cases), "status").where("event = 'start'").first()
    assert double["inputs_digest"] not in (digest, sinks.report_envelope(cases.limit(0), "status").first()["inputs_digest"])
    path = str(tmp_path / "r")
    sinks.write_report(report, path)
    with pytest.raises(AnalysisException):
        sinks.write_report(report, path)


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(
        "filename,label,prompted_text,duration_seconds,rms,wake_text\na.wav,BG,спри,1.5,0.01,\n", encoding="utf-8-sig"
    )
    row = scans.read_table_csv(spark, str(path), schemas.DATASET_MANIFEST).first()
    assert (row["filename"], row["duration_seconds"], row["wake_text"]) == ("a.wav", 1.5, None)


def test_csv_columns_by_name(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("b,x,a\n2.5,no,one\n", encoding="utf-8")
    assert tuple(scans.read_table_csv(spark, str(path), "a string, b double").first()) == ("one", 2.5)
    with pytest.raises(ValueError, match="no column c"):
        scans.read_table_csv(spark, str(path), "a string, c int")
    path.write_text("a,b\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no rows"):
        scans.read_table_csv(spark, str(path), "a string, b double")


def test_no_cases_is_an_error(spark):
    empty = spark.createDataFrame([("start",)], "event string").selectExpr("event", "'' prompt_id", "'' status", "'' sha256", "'' text")
    with pytest.raises(ValueError, match="no cases"):
        jn.check_cases(empty)


def test_whole_rows_and_flagged_duplicates(spark):
    base = spark.createDataFrame([("p", "t", "s", "1", "r")], "prompt_id string, text string, sha256 string, attempt_id string, reference_text string")
    other = spark.createDataFrame([("p", "b", "s", "9", "r"), ("p", "a", "s", "1", "r")], base.schema)
    row = jn.gather_alternatives(base, {"x": other}).first()
    assert (row["texts"], row["violations"]) == (["a"], ["duplicate_id"])
    runs = spark.createDataFrame([("k", "bg", "bg", "zz", 1), ("k", "bg", "bg", "aa", 9), ("k", "en", "bg", "q", 5)], "k string, mode string, route string, t string, n int")
    assert tuple(select_by_route(runs, "k", "mode", "route", ["t", "n"])) == ("k", "bg", "aa", 9, True)
    assert tuple(select_by_route(runs, "k", "mode", "route", ["t", "n"], ["n"])) == ("k", "bg", "zz", 1, True)


def select_by_route(*args):
    return tr.select_by_route(*args).first()


def test_plan(spark, tmp_path):
    path = tmp_path / "plan.md"
    path.write_text("# Plan\n| id | label | text |\n|---|---|---|\n| BG01 | BG | Спри музиката |\n| MX02 | EN | x |\n", encoding="utf-8")
    rows = {r["prompt_id"]: (r["text"], r["violation"]) for r in scans.read_plan(spark, str(path)).collect()}
    assert rows == {"BG01": ("Спри музиката", None), "MX02": ("x", "label_mismatch")}
    assert scans.expected_plan_ids(spark).count() == 24


def test_round_robin_plan(spark):
    phrases = spark.createDataFrame(
        [(lang, i, x) for lang, texts in (("BG", "ab"), ("EN", "xyzuvw")) for i, x in enumerate(texts)],
        "language string, slot long, phrase string",
    )
    plan = scans.round_robin_plan(phrases, 5)
    got = {lang: [r["phrase"] for r in plan.where(F.col("language") == lang).orderBy("item").collect()] for lang in ("BG", "EN")}
    assert got == {"BG": ["a", "b", "a", "b", "a"], "EN": ["x", "y", "z", "u", "v"]}


def test_evidence_csv_report(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    sinks.write_csv_report(df, str(tmp_path / "c"), ["b", "a"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["b", "a"]


def run(spark, rows):
    return spark.createDataFrame(
        rows, "prompt_id string, sha256 string, attempt_id string, reference_text string, status string, errors long"
    )


def test_paired_compare_guards(spark):
    base = run(spark, [("1", "s", "a", "r", "ok", 1), ("2", "s", "a", "r", "ok", 1), ("3", "s", "a", "r", "ok", 1)] + [("4", "s", "a", "r", "ok", 1)] * 50)
    other = run(spark, [("1", "s", "a", "r", "ok", 0), ("2", "x", "a", "r", "ok", 0), ("3", "s", "a", "r", "error", None)] + [("4", "s", "a", "r", "ok", 0)] * 50)
    got = {r["b_prompt_id"]: r["violations"] for r in jn.paired_compare(base, other).collect()}
    assert got == {"1": [], "2": ["sha256_mismatch"], "3": ["run_failed"], "4": ["duplicate_id"]}


def test_coverage_diff(spark):
    expected = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4), ("d", 4)], "k string, v int")
    actual = spark.createDataFrame([("a", 1), ("c", 3), ("x", 9), ("d", 4)], "k string, v int")
    got = {r["k"]: (r["kind"], r["fields"]) for r in jn.coverage_diff(expected, actual, "k", ["v"]).collect()}
    assert got == {"b": ("missing", None), "x": ("extra", None), "c": ("mismatch", "v"), "d": ("duplicate", "")}


def test_labels_resume(spark):
    rec = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "f string")
    old = spark.createDataFrame([("a", "BG"), ("b", "  "), ("c", "EN"), ("c", "EN")], "f string, l string")
    new = spark.createDataFrame([("c", "BG"), ("d", "")], "f string, l string")
    got = sorted(tuple(r) for r in jn.merge_labels(rec, old, new, "f", "l").collect())
    assert got == [("a", "BG"), ("c", "BG")]


def test_reconciliation_tasks_grow_with_the_rows(spark, monkeypatch):
    from voxloom.operators import journal

    monkeypatch.setattr(journal, "RECONCILED", 100, raising=False)
    listed = spark.range(1000).selectExpr("CASE WHEN id < 2 THEN NULL ELSE id END AS k")
    present = spark.range(2000).selectExpr("CASE WHEN id < 3 THEN NULL ELSE id DIV 2 + 500 END AS k")
    out = journal.reconcile_keys(listed, present, "k")
    assert out.rdd.getNumPartitions() >= 30
    want = [(None, "listed_only"), (None, "present_only")]
    want += [(k, "listed_only") for k in range(2, 501)] + [(k, "present_only") for k in range(1000, 1500)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
