"""Fill-in-middle, filter dedup and Merkle manifest against brute force and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import fill_middle, fuse_dedup, merkle
from voxloom.llm.common import ready

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "one", "two  words", "two words", "é🙂漢" * 50, "x" * 300_000, "a <P> b", "ends with <", "S> begins"]


@pytest.fixture(scope="module")
def sp(spark):
    return ready(spark)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table(sp, rows, parts=3):
    df = sp.createDataFrame(rows, DOCS).repartition(parts)
    return df.selectExpr("*", "'x' AS row", "'y' AS digest", "1 AS keep", "2 AS n", "3 AS pos", "4 AS grp", "5 AS key", "6 AS form")


def odd_rows(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "de", None]), None, i) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 3))), "en", "s", None) for i in range(n)]
    return rows + [(None, "no key", None, None, None), (None, "no key", None, None, None), (3, "one", "en", None, 3), (3, "other", "en", None, 3)]


# --- fill in the middle ----------------------------------------------------------


def filled(key, text):
    """The contract, written down once more."""
    text = text or ""
    h = sha("1:" + ("" if key is None else str(key)))
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h4 % 100 < 20 else (n, "psm", a, b - a, p + s + m)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 15])
def test_fill_in_middle(sp, chunk):
    rows = [r for r in odd_rows() if chunk > 1 or len(r[1] or "") < 1000]
    docs = table(sp, rows)
    got = sorted(map(tuple, fill_middle.fill_in_middle(docs, chunk=chunk).collect()), key=str)
    want = []
    for key, text, *_ in rows:
        n, form, a, m, out = filled(key, text)
        want.append((key, n, form, a, m, sha(out), sha(text or "")))
    assert got == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_texts_and_empty_table(sp):
    docs = table(sp, odd_rows())
    got = sorted((str(r[0]), r[1], r[2]) for r in fill_middle.transformed_texts(docs, chunk=1000).collect())
    assert got == sorted((str(k), *filled(k, t)[1::3]) for k, t, *_ in odd_rows())
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    assert fill_middle.transformed_texts(docs.limit(0)).count() == 0


def test_restoration_reads_the_output_alone():
    """Any cut of an output into pieces at part borders gives the text's parts back."""
    for form in ("psm", "spm"):
        parts = {"prefix": ["<P>a<", "S"], "suffix": ["<S>>", "<"], "middle": ["<M>", "<M"]}
        bodies = [p.encode() for part in fill_middle.ORDER[form] for p in parts[part]]
        back = b"".join(x for _, x in sorted(fill_middle.original_positions(form, iter(bodies))))
        assert back == b"a<S<M><"


# --- exact dedup -------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 17, 1000, 70_000])
def test_filters_hold_their_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    stored = fuse_dedup.build_filter(np.concatenate([keys, keys]))
    assert fuse_dedup.may_contain(stored, keys).all()
    assert fuse_dedup.may_contain(stored, rng.integers(0, 2**63, 50_000, dtype=np.uint64)).mean() < 0.01
    assert len(stored) <= max(100, 2.5 * n if n < 5000 else 1.3 * n)


def groups_of(rows):
    own = {}
    for key, text, *_ in rows:
        own.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(key)
    return own


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_exact_dedup(sp, batches, monkeypatch):
    monkeypatch.setattr(fuse_dedup, "BUCKET_KEYS", 5)
    monkeypatch.setattr(fuse_dedup, "PROBE_KEYS", 3)
    rows = odd_rows()
    got = fuse_dedup.deduplicate(table(sp, rows), batches=batches).collect()
    own = groups_of(rows)
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        text = next(t for t in own if hashlib.sha256(t.encode()).digest() == bytes(r["digest"]))
        keys = [k for k in own[text] if k is not None]
        assert r["doc_id"] in own[text]
        assert (r["keep"], r["group_size"]) == (min(keys) if keys else None, len(own[text]))
        if r["kept"]:
            assert r["doc_id"] == r["keep"]
            kept[text] = kept.get(text, 0) + 1
    assert kept == dict.fromkeys(own, 1)


def test_exact_dedup_compares_bytes(sp):
    """A weak digest puts different texts together: in a batch, and against a snapshot."""
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1)
    docs = table(sp, [(i, f"text {i}", "en", None, 0) for i in range(400)])
    for batches in (1, 2):
        with pytest.raises(Exception, match="share"):
            fuse_dedup.deduplicate(docs, batches=batches, digest=weak).collect()
    # One text a digest in each batch, another one in the snapshot.
    first = docs.where("doc_id = 0").selectExpr("'same' AS text")
    other = docs.where("doc_id = 0").selectExpr("'another' AS text")
    constant = lambda text: F.lit(b"1")
    held = fuse_dedup.take_snapshot(fuse_dedup.distinct_texts(first, "text", constant, 1), [])
    texts = fuse_dedup.distinct_texts(other, "text", constant, 1)
    with pytest.raises(Exception, match="share the digest"):
        fuse_dedup.confirm(texts.select("digest"), texts, held)


def test_exact_dedup_empty(sp):
    assert fuse_dedup.deduplicate(table(sp, odd_rows()).limit(0)).count() == 0


# --- Merkle manifest -----------------------------------------------------------------


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        own = out[-1]
        out.append([sha("".join(own[i:i + 2])) for i in range(0, len(own), 2)])
    return out


def path_of(levels, i):
    out = []
    for own in levels[:-1]:
        j = i ^ 1
        out.append(own[j] if j < len(own) else "")
        i //= 2
    return out


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("bits,n", [(1, 40), (2, 65), (8, 300)])
def test_manifest(sp, bits, n, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", bits)
    monkeypatch.setattr(merkle, "BLOCK", 1 << bits)
    rows = odd_rows(n=n)
    docs = table(sp, rows, 5)
    got = merkle.manifest(docs, COLUMNS).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    groups = {}
    for key, text, lang, source, n_chars in rows:
        groups.setdefault(lang, []).append((key is not None, key or 0, leaf_of((key, source, lang, n_chars, text))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(own)]) for g, own in groups.items()}
    crown = levels_of([trees[g][-1][0] for g in names])
    want = []
    for at, g in enumerate(names):
        for i, (there, key, leaf) in enumerate(sorted(groups[g])):
            want.append((key if there else None, leaf, trees[g][-1][0], crown[-1][0], path_of(trees[g], i) + path_of(crown, at)))
    have = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [s["node"] for s in r["path"]]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r["folded"] == r["root"] for r in got)


def test_manifest_finds_tampering_and_odd_tables(sp):
    rows = [(i, f"t{i}", "en", None, i) for i in range(9)]
    docs = table(sp, rows)
    changed = F.when(F.col("doc_id") == 4, merkle.leaf(F.lit("forged")))
    got = merkle.manifest(docs, COLUMNS, altered=changed).withColumn(
        "folded", merkle.fold(F.coalesce("other", "leaf"), F.col("path"))
    ).collect()
    assert {r["doc_id"] for r in got if r["folded"] != r["root"]} == {4}
    one = merkle.manifest(docs.where("doc_id = 1"), COLUMNS).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["path"]) for r in one] == [(leaf_of((1, None, "en", 1, "t1")),) * 3 + ([],)]
    assert merkle.manifest(docs.limit(0), COLUMNS).count() == 0
    # Each lang one leaf: the upper tree alone.
    many = table(sp, [(i, "t", f"l{i % 7}", None, 0) for i in range(7)])
    assert len({r["root"] for r in merkle.manifest(many, COLUMNS).collect()}) == 1
