"""The pipeline's stages against a brute-force version, one after another."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import WORD, brute_base, brute_components, brute_print
from voxloom.llm import quality, toxicity
from voxloom.llm.common import table

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after every stage, by stage name; documents under ``start``."""
    docs = table(spark, ROOT, "documents")
    out = {"start": docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        out[name] = rows
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "toxicity", "simhash_near_dedup", "mix_sources", "packing"
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_stage(spark, kept):
    model = quality.train(table(spark, ROOT, "documents"), table(spark, ROOT, "labels"))
    want = []
    for r in kept["start"]:
        data = [(r["text"] or "").encode()]
        good = model is None or model.probability(data, quality.Words(data))[0] >= 0.5
        if good and not brute_base(r["text"])[-1]:
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in kept["quality_rules"]) == sorted(want)
    start = by_id(kept["start"])
    assert all(start[r["doc_id"]] == r for r in kept["quality_rules"])


def test_toxicity_stage(spark, kept):
    docs = spark.createDataFrame(kept["quality_rules"], table(spark, ROOT, "documents").schema)
    model = toxicity.train(docs, table(spark, ROOT, "labels"))
    want = [
        r["doc_id"] for r in kept["quality_rules"]
        if model is None or model.score([(r["text"] or "").encode()])[0][0] < 0.5
    ]
    assert sorted(r["doc_id"] for r in kept["toxicity"]) == sorted(want)


def test_near_dedup_stage(kept):
    rows = sorted(kept["toxicity"], key=lambda r: r["doc_id"])
    heads = brute_components([brute_print(r["text"]) for r in rows])
    want = sorted({rows[h]["doc_id"] for h in heads})
    assert sorted(r["doc_id"] for r in kept["simhash_near_dedup"]) == want


def test_mix_stage(kept):
    size, taken = {}, {}
    for rows, words in ((kept["simhash_near_dedup"], size), (kept["mix_sources"], taken)):
        for r in rows:
            words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left = {}, set(names)
    while True:
        rest = 1.5 * sum(size.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 2 * size[s]]
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= set(over)
    target |= {s: weight[s] * level for s in left}
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in names)
    copies = {}
    for r in kept["mix_sources"]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 2


def test_packing_stage(kept):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = sum(len(e.ids) + 1 for e in model.encode_batch([r["text"] or "" for r in kept["mix_sources"]], add_special_tokens=False))
    assert sum(r["length"] for r in kept["packing"]) == ids
    fill = {}
    for r in kept["packing"]:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    sizes = np.array(list(fill.values()))
    assert sizes.max() <= 1024 and sizes.sum() >= 0.9 * 1024 * len(sizes)


def test_run(spark, kept):
    rows = corpus_pipeline.run(spark, ROOT)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    total = sum(r["length"] for r in rows.collect())
    assert total == sum(r["length"] for r in kept["packing"])
