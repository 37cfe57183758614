import unicodedata

import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as tx
from voxloom.operators.evaluate import score_words, word_error_report
from voxloom.operators.keywords import contains_wake

PAIRS = [
    ("НЕ, спирай!", "не спирай", 0),
    ("a b c", "a x c", 1),
    ("a b", "a", 1),
    ("a", "a b", 1),
    ("é", "é", 0),
    ("не спирай", "спирай", 1),
    ("one two three four", "", 4),
    ("b a b a", "a b a b", 2),
]


def _distance(ref, hyp):
    row = list(range(len(hyp) + 1))
    for i, r in enumerate(ref, 1):
        new = [i]
        for j, h in enumerate(hyp, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (r != h)))
        row = new
    return row[-1]


def test_word_errors(spark):
    df = spark.createDataFrame(PAIRS, "r string, h string, want long")
    for row in score_words(df, "r", "h").collect():
        assert row["errors"] == row["want"], row
        assert row["wer"] == pytest.approx(row["want"] / row["reference_words"])


def test_empty_reference_is_an_error_row(spark):
    df = spark.createDataFrame([("...", "a"), ("a", "a")], "r string, h string")
    rows = {r["r"]: r for r in score_words(df, "r", "h").collect()}
    assert rows["..."]["status"] == "empty_reference" and rows["..."]["errors"] is None
    assert rows["a"]["status"] == "ok"


def test_distance_of_long_texts_uses_every_word(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(12):
        ref = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 700))]
        hyp = [w for w in ref if rng.random() > 0.2] + [f"x{i}"]
        rows.append((" ".join(ref), " ".join(hyp), _distance(ref, hyp)))
    df = spark.createDataFrame(rows, "r string, h string, want long")
    assert all(r["errors"] == r["want"] for r in score_words(df, "r", "h").collect())


def test_report_separates_corpus_and_macro(spark):
    df = spark.createDataFrame([("BG", "a b c d", "a b c x"), ("BG", "a", "b")], "g string, r string, h string")
    total = [r for r in word_error_report(score_words(df, "r", "h"), "g").collect() if r["g"] is None][0]
    assert total["corpus_wer"] == pytest.approx(2 / 5)
    assert total["macro_wer"] == pytest.approx((0.25 + 1.0) / 2)
    assert total["exact"] == 0


TEXTS = [
    "Straße  ÉCOLE", "Café", "’tis", " .,! hi !", "ΑΣ", "İstanbul", "µ-law", "ŉ", "ſ", "АУРОРА", "É\tx y", "ﬁne", "½", "a—b", None,
]


def test_normalisation_equals_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    out = df.select(
        "t", tx.nfc(F.col("t")).alias("nfc"), tx.nfc_casefold(F.col("t")).alias("fold"),
        tx.nfkc_casefold(F.col("t")).alias("kfold"), tx.review_normalise(F.col("t")).alias("review"),
    ).collect()
    for r in out:
        if r["t"] is None:
            assert r["nfc"] is None and r["review"] is None
            continue
        t = r["t"]
        assert r["nfc"] == unicodedata.normalize("NFC", t)
        assert r["fold"] == unicodedata.normalize("NFC", t).casefold()
        assert r["kfold"] == unicodedata.normalize("NFKC", t).casefold()
        want = " ".join(unicodedata.normalize("NFC", t).casefold().replace("’", "'").split()).strip(" .,!")
        assert r["review"] == want, t


def test_safe_classes_never_change_a_character(spark):
    """Every character kept in the JVM must fold there as Python folds it."""
    chars = [chr(c) for c in [*range(1, 0x600), *range(0x2000, 0x2100)]]
    df = spark.createDataFrame([(c,) for c in chars], "t string")
    rows = df.select(
        "t", tx.nfc(F.col("t")).alias("n"), tx.nfc_casefold(F.col("t")).alias("f"), tx.nfkc_casefold(F.col("t")).alias("k")
    ).collect()
    for r in rows:
        assert r["n"] == unicodedata.normalize("NFC", r["t"]), hex(ord(r["t"]))
        assert r["f"] == unicodedata.normalize("NFC", r["t"]).casefold(), hex(ord(r["t"]))
        assert r["k"] == unicodedata.normalize("NFKC", r["t"]).casefold(), hex(ord(r["t"]))


def test_wake_words(spark):
    cases = [
        ("Аурора, спри", True), ("hey AURORA!", True), ("auroras here", True), ("xaurora", False),
        ("аврора", False), ("قل أورورا الآن", True), ("أورورات", False), ("", False),
    ]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r["hit"] == r["want"] for r in df.withColumn("hit", contains_wake(F.col("t"))).collect())
