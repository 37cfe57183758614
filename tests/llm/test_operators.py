"""The corpus operators against brute-force versions and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from voxloom.llm import html_main, lm_score, mixing, multi_index, packing, quality, simhash, tokens, toxicity, warc
from voxloom.llm.common import LinkForest, components, fold_py, ready

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sp(spark):
    return ready(spark)


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(seed=3, n=300):
    rng = random.Random(seed)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", ",", ".", "'s", "'ll", "7", "<|endoftext|>", "!!", " ",
             "　", "\x1c", "漢", "🙂", " word", " Word,", "..", "\r\n", "\x85", "é"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def docs_of(sp, texts, extra=True):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    df = sp.createDataFrame(rows, DOCS)
    if extra:
        df = df.selectExpr("*", "'x' AS size", "1 AS fp", "'y' AS kept", "2 AS score", "3 AS n_tokens", "4 AS _text")
    return df


ODD = [None, "", " \n\t ", "one", "one", "two words", "x" * 5000, "Line\nLine\n\nLine", "# $ <tag> & | * %"]


# --- token counts and packing -------------------------------------------------


def model():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encode_like_the_tokeniser():
    texts = odd_texts(n=3000) + ["plain words, and more. " * 40]
    want = [e.ids for e in model().encode_batch(texts, add_special_tokens=False)]
    data = [t.encode() for t in texts]
    assert [x.tolist() for x in tokens.encode_ids(data)] == want
    assert tokens.encode_lengths(data).tolist() == [len(x) for x in want]


def test_long_text_is_cut_at_safe_places():
    rng = random.Random(1)
    text = " ".join(rng.choice(["it's", "word,", "Ünï", "x.\n y", "7 7", "  two"]) for _ in range(4000))
    pieces = tokens.safe_pieces(text, 500)
    assert "".join(pieces) == text and len(pieces) > 10
    m = model()
    joined = [i for e in m.encode_batch(pieces, add_special_tokens=False) for i in e.ids]
    assert joined == m.encode(text, add_special_tokens=False).ids
    assert tokens.safe_pieces("y" * 5000, 500) == ["y" * 5000]


def test_token_counts_rows(sp):
    got = {r["doc_id"]: r for r in tokens.token_counts(docs_of(sp, ODD + ["a " * 2000])).collect()}
    m = model()
    for i, t in enumerate(ODD + ["a " * 2000]):
        n = len(m.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)
    assert tokens.token_counts(docs_of(sp, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 5, 40)])
def test_packing_places_every_id_once(sp, limits):
    rng = random.Random(2)
    texts = ODD + [words(rng, rng.choice([1, 2, 30, 400, 3000])) for _ in range(150)]
    docs = docs_of(sp, texts).repartition(3)
    rows = packing.pack_documents(docs, limits=limits).collect()
    m = model()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array(m.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
    short = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= min(limits.tokens, limits.loss_tokens) and len(own) <= limits.segments
        short += at < min(limits.tokens, limits.loss_tokens) and len(own) < limits.segments
    assert short <= 3


def test_packing_mixes_bearing_and_other(sp):
    rng = random.Random(4)
    docs = docs_of(sp, [words(rng, 20) for _ in range(200)]).coalesce(1)
    limits = packing.Limits(512, 64, 128)
    rows = packing.pack_documents(docs, bearing=docs.doc_id % 2 == 0, limits=limits).collect()
    seqs = {}
    for r in rows:
        s = seqs.setdefault(r["sequence_id"], [0, 0, 0])
        s[0] += r["length"]
        s[1] += 1
        s[2] += r["length"] if r["doc_id"] % 2 == 0 else 0
    assert all(a <= 512 and b <= 64 and c <= 128 for a, b, c in seqs.values())
    assert packing.pack_documents(docs.limit(0)).count() == 0


# --- vectors --------------------------------------------------------------------


def brute_links(vectors, threshold=0.9):
    good = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = (x @ x.T >= threshold) & ~np.eye(len(ids), dtype=bool)
    forest = LinkForest(len(ids))
    forest.link(*np.nonzero(near))
    out = {i: (0, i) for i, _ in vectors}
    for at, i in enumerate(ids):
        out[i] = (int(near[at].sum()), ids[forest.parent[at]])
    return out


def test_multi_index_links(sp, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL", 60)
    monkeypatch.setattr(multi_index, "BLOCK", 64)
    monkeypatch.setattr(multi_index, "CHUNK", 100)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 16)).astype(np.float32)
    close = base[:200] + rng.normal(scale=0.12, size=(200, 16)).astype(np.float32)
    group = base[3] + rng.normal(scale=0.05, size=(300, 16)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate((base, close, group, base[:20])))]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0] * 15 + [None]), (n + 4, [])]
    df = sp.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS n", "3 AS id")
    want = brute_links(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.link_vectors(df).collect()}
    assert len(got) == len(rows)
    linked, found = sum(v[0] for v in want.values()), sum(v[0] for v in got.values())
    assert found <= linked and found >= 0.98 * linked
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    assert multi_index.link_vectors(df.limit(0)).count() == 0


def test_multi_sequence_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    sums = (a[:, None] + b[None, :]).ravel()
    got = multi_index.multi_sequence(a, b, 63)
    assert sorted(got) == list(range(63)) and np.all(np.diff(sums[got]) >= 0)
    assert multi_index.multi_sequence(a, b, 5) == got[:5]


def test_components_of_chains_and_hubs(sp):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 500)] + [(10_000, 10_001 + i) for i in range(300)]
    rng.shuffle(edges)
    got = dict(components(sp.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert all(got[i] == 0 for i in range(501)) and all(got[10_001 + i] == 10_000 for i in range(300))


# --- archive ---------------------------------------------------------------------


def test_archive_round_trip(sp, tmp_path):
    big, other = "é" * 700, "z" * 1000
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None),
            (7, "u7", other), (7, "u7", other), (8, "u\n8", ""), (None, "u9", big), (None, "u10", "w" * 2000)]
    df = sp.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS strong")
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    assert sp.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in rows})
    read = warc.read_archive(sp, path).collect()
    assert len(read) == len(rows)
    for r in read:
        head, sep, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)$", head).group(1))
        assert sep and len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")
        block = rest[:-4]
        assert block.startswith(b"HTTP/1.1 200 OK\r\n")
        payload = block.partition(b"\r\n\r\n")[2]
        assert payload == (b"" if b"WARC-Type: revisit" in head else bytes(r["payload"]))
    got = sorted(warc.archive_round_trip(df).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        texts = {p: (h or "") for p, _, h in rows if p is not None}
        if r["page_id"] is not None:
            data = texts[r["page_id"]].encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None}
    assert kinds[1] == kinds[2] == ("revisit", 3) and kinds[3] == ("response", None)
    assert kinds[4] == kinds[5] == kinds[6] == kinds[7] == kinds[8] == ("response", None)
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in got if r["page_id"] is None) == [("response", 0), ("revisit", 3)]
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_urls_cannot_forge_header_fields(sp, tmp_path):
    big = "b" * 1500
    urls = ["http://x/\r\nWARC-Refers-To: <urn:page:99>", "http://x/?WARC-Type: revisit", "a\tb\x00c\x7f", "http://x/%41"]
    df = sp.createDataFrame([(i, u, big + str(i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = warc.archive_round_trip(df).collect()
    assert all((r["record_type"], r["refers_to"], r["payload_bytes"]) == ("response", None, 1501) for r in got)
    warc.write_archive(df, str(tmp_path / "forged"))
    for r in warc.read_archive(sp, str(tmp_path / "forged")).collect():
        head = bytes(r["header"]).partition(b"\r\n\r\n")[0].split(b"\r\n")
        assert len(head) == 9 and bytes(r["record"]).count((big + str(r["page_id"])).encode()) == 1
        assert (b"%41" in head[4]) == (r["page_id"] == 3)


def test_damaged_payload_fails(sp, tmp_path):
    df = sp.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    path = str(tmp_path / "a")
    warc.write_archive(df, path)
    held = sp.read.parquet(f"{path}/payloads").collect()
    changed = sp.createDataFrame([(r["strong"], bytearray(b"other")) for r in held], "strong string, payload binary")
    changed.write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(sp, path).collect()


# --- mixing -----------------------------------------------------------------------


def test_mix_meets_targets(sp):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    rows += [(900, None, "a"), (901, " \t", "e"), (5, "again here", "b")]
    df = sp.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS weight", "3 AS target")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target = set(order), {}
    while True:
        rest = 1.5 * sum(size.values()) - sum(target.values())
        over = [s for s in left if weight[s] * rest / sum(weight[x] for x in left) > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left.discard(s)
    for s in left:
        target[s] = weight[s] * rest / sum(weight[x] for x in left)
    source = {}
    for i, t, s in rows:
        source.setdefault((i, len(WORD.findall(t or ""))), []).append(s)
    taken = {}
    for r in got:
        s = source[r["doc_id"], r["size"]].pop()
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[s]
        assert math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert mixing.mix(df.limit(0)).count() == 0


def test_repeat_rows_carries_the_mix(sp):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(0, 30)), f"s{i % 3}") for i in range(200)] + [(7, "twice here", "s1"), (999, None, "s0")]
    df = sp.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS _size", "2 AS _k", "3 AS size")
    taken = mixing.mix(df)
    want = sum(r["taken"] for r in taken.collect())
    out = mixing.repeat_rows(df, taken)
    assert out.columns == df.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) == want
    assert out.where("doc_id = 999").count() == 1


# --- SimHash ------------------------------------------------------------------------


def brute_print(text):
    tokens_ = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not tokens_:
        return 0
    n = max(1, len(tokens_) - 3)
    hs = [xxhash.xxh64_intdigest(" ".join(tokens_[i:i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def brute_components(prints):
    forest = LinkForest(len(prints))
    x = np.array(prints, dtype=np.uint64)
    forest.link(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4))
    return forest.parent.tolist()


def test_fingerprint_is_xxhash64_of_spark(sp):
    row = sp.sql("SELECT xxhash64('a b c d') AS h").first()
    assert row["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42) == brute_print("A b C d")


def test_near_duplicates(sp, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "CHUNK", 32)
    rng = random.Random(10)
    texts = list(ODD)
    for _ in range(60):
        base = words(rng, rng.randint(3, 400)).split()
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"N{rng.randrange(99)}É"
            texts.append(rng.choice([" ", "\n"]).join(copy))
    want_print = [brute_print(t) for t in texts]
    want = brute_components(want_print)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(sp, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i]["fingerprint"] == f"{want_print[i]:016x}"
        assert got[i]["component_id"] == want[i]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs_of(sp, texts)).collect())
    assert kept == sorted(set(want))
    assert simhash.near_duplicates(docs_of(sp, ODD).limit(0)).count() == 0


def test_tree_search_is_exact(sp, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 900, dtype=np.int64)
    flips = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, int(rng.integers(1, 8)), replace=False)) for b in base[:400]]
    prints = list(dict.fromkeys([int(b) for b in base] + flips))
    edges = simhash.links(sp.createDataFrame([(p,) for p in prints], "fp long")).collect()
    at = {p: i for i, p in enumerate(prints)}
    forest = LinkForest(len(prints))
    forest.link(np.array([at[e["a"]] for e in edges]), np.array([at[e["b"]] for e in edges]))
    assert forest.parent.tolist() == brute_components(prints)


def test_repeated_and_unnamed_rows(sp):
    rows = [(3, "same text here now ok"), (3, "same text here now ok"), (None, "same text here now ok"), (1, "other words entirely and different")]
    df = sp.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [("1", 1), ("3", 3), ("3", 3), ("None", 3)]
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(df).collect()) == ["1", "3"]


# --- learned scores -------------------------------------------------------------------


def test_lm_difference_by_hand_and_by_join(sp):
    rng = random.Random(12)
    texts = ODD + [words(rng, 50) for _ in range(40)]
    docs = docs_of(sp, texts)
    target = sp.createDataFrame([(words(rng, 60, 20),) for _ in range(20)] + [(None,)], "text string")
    fast = {r["doc_id"]: r for r in lm_score.score_documents(docs, target).collect()}
    slow = {r["doc_id"]: r for r in lm_score.score_documents(docs, target, travel=0).collect()}
    assert len(fast) == len(slow) == len(texts)

    m = model()
    def ids(t):
        return m.encode(t or "", add_special_tokens=False).ids
    sides = [[ids(r["text"]) for r in target.collect()], [ids(t) for t in texts]]
    pair, uni, hist = [{}, {}], [{}, {}], [{}, {}]
    for k, side in enumerate(sides):
        for x in side:
            for h, w in zip([None, *x[:-1]], x):
                pair[k][h, w] = pair[k].get((h, w), 0) + 1
                uni[k][w] = uni[k].get(w, 0) + 1
                hist[k][h] = hist[k].get(h, 0) + 1
    size = 1 + max(max(uni[0]), max(uni[1]))
    scale = sum(uni[0].values()) / sum(uni[1].values())
    def loss(k, h, w):
        s = scale if k else 1.0
        u = (uni[k].get(w, 0) * s + 1) / (sum(uni[k].values()) * s + size)
        c = hist[k].get(h, 0)
        return -math.log(0.7 * pair[k].get((h, w), 0) / c + 0.3 * u if c else u)
    for i, t in enumerate(texts):
        x = ids(t)
        want = sum(loss(1, h, w) - loss(0, h, w) for h, w in zip([None, *x[:-1]], x)) / max(1, len(x))
        assert fast[i]["n_tokens"] == slow[i]["n_tokens"] == len(x)
        assert math.isclose(fast[i]["score"], want, abs_tol=1e-5)
        assert math.isclose(slow[i]["score"], want, abs_tol=1e-9)
    assert lm_score.score_documents(docs.limit(0), target).count() == 0
    assert lm_score.score_documents(docs, target.limit(0)).count() == len(texts)


def toxic_corpus(sp, n=1500, seed=14):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = words(rng, rng.randint(5, 80), 2000).split()
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["awful", "nasty", "horridly", "horridness"]))
        rows.append((i, " ".join(text), "en", "s", 0))
        if rng.random() < 0.8:
            labels.append((i, 1, int(bad)))
    rows += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (n + 2, "horridful thing", "en", "s", 0)]
    labels += [(3, 1, None), (None, 0, 1), (7, 1, labels[0][2])]
    return sp.createDataFrame(rows, DOCS), sp.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((r[0], r[2]) for r in labels if r[0] != 7)


def test_block_max_search_is_exact(monkeypatch):
    rng = np.random.default_rng(2)
    def vector():
        t = np.sort(rng.choice(40, rng.integers(1, 9), replace=False))
        w = rng.random(len(t)) + 0.1
        return t, w / np.linalg.norm(w)
    examples = [vector() for _ in range(700)] + [(np.zeros(0, np.int64), np.zeros(0))]
    examples += [examples[5]] * 30
    dense = np.zeros((len(examples), 40))
    for i, (t, w) in enumerate(examples):
        dense[i, t] = w
    queries = [vector() for _ in range(400)] + [examples[5], examples[-40]]
    without = np.array([-1] * 400 + [5, -1])
    for common in (0, 7, 40):
        monkeypatch.setattr(toxicity, "COMMON", common)
        index = toxicity.BlockMaxIndex(examples, 40)
        for q, no, (ids, got) in zip(queries, without.tolist(), index.nearest(queries, 16, without)):
            sims = dense[:, q[0]] @ q[1]
            want = sorted((-round(float(s), 12), i) for i, s in enumerate(sims) if s > 1e-12 and i != no)[:16]
            assert [-w[0] for w in want] == pytest.approx(got.tolist(), abs=1e-9)
            assert len(set(ids.tolist())) == len(want) and no not in ids
        assert 0 < index.visited <= index.seen
    assert len(toxicity.BlockMaxIndex([], 40).nearest([examples[0]], 4)[0][0]) == 0


def brute_scores(docs, labels, texts):
    """Scores by the definition: all cosines, votes, isotonic means."""
    def terms(t):
        out = {}
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            out[w[:toxicity.STEM]] = out.get(w[:toxicity.STEM], 0) + 1
        return out
    own = {k: t for k, t in docs}
    known = [(k, own[k], y) for k, y in labels.items() if fold_py(k) != 0]
    known.sort()
    df, of = {}, [0, 0]
    for _, t in docs:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    seen = {}
    for _, t, y in known:
        of[y] += 1
        for w in terms(t):
            seen.setdefault(w, [0, 0])[y] += 1
    def telling(b, a):
        n1, n0 = of[1], of[0]
        p = (a + b) / (n1 + n0)
        part = lambda o, e: o * math.log(o / e) if o > 0 else 0.0
        g2 = 2 * (part(a, n1 * p) + part(b, n0 * p) + part(n1 - a, n1 * (1 - p)) + part(n0 - b, n0 * (1 - p)))
        odds = abs(math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)))
        return g2 >= toxicity.MIN_G2 and odds >= toxicity.MIN_LOG_ODDS
    idf = {w: (toxicity.TELLING if telling(*c) else 1) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, c in seen.items()}
    def vector(t):
        v = {w: (1 + math.log(n)) * idf[w] for w, n in terms(t).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}
    vectors = [vector(t) for _, t, _ in known]
    def vote(v, no=-1):
        sims = sorted((-round(sum(x * e.get(w, 0.0) for w, x in v.items()), 12), i) for i, e in enumerate(vectors) if i != no)
        sims = [(-s, i) for s, i in sims[:16] if s < 0]
        power = [s ** toxicity.POWER for s, _ in sims]
        return sum(p for p, (_, i) in zip(power, sims) if known[i][2]) / (sum(power) + toxicity.FAR) if sims else -1.0
    raw = [vote(v, i) for i, v in enumerate(vectors)]
    knots = toxicity.Model._calibrate(np.array(raw), np.array([y for *_, y in known]), np.ones(len(known)))
    prior = of[1] / len(known)
    got = [vote(vector(t)) for t in texts]
    return [prior if r < 0 else float(np.interp(r, *knots)) for r in got]


def test_toxicity_scores_equal_brute_force(sp):
    docs, labels, _ = toxic_corpus(sp, 400)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] is not None and r["toxic"] is not None}
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()}
    want = brute_scores(rows, known, [t for _, t in rows])
    assert [got[k] for k, _ in rows] == pytest.approx(want, abs=1e-8)


def test_labelled_samples_keep_their_bound(sp):
    """A key on many rows counts once, with its least text, in both samples."""
    rows = [(1, f"text {i:04d}", "en", "s", 0) for i in range(5000)] + [(k, "other", "en", "s", 0) for k in (2, 3, 4)]
    rows += [(6, None, "en", "s", 0), (6, None, "en", "s", 0)]
    docs = sp.createDataFrame(rows, DOCS)
    labels = sp.createDataFrame([(k, 1, k % 2) for k in (1, 2, 3, 4, 6)], "doc_id long, quality int, toxic int")
    good = quality.labelled_sample(docs, labels, "quality", 10, "doc_id", "text").collect()
    assert sorted((r[0], r[2]) for r in good) == [(1, "text 0000"), (2, "other"), (3, "other"), (4, "other"), (6, None)]
    assert quality.labelled_sample(docs, labels, "quality", 2, "doc_id", "text").count() == 2
    picked, _ = toxicity._rows(docs, labels, "doc_id", "text", "toxic", 10)
    keys = [k for k in (1, 2, 3, 4, 6) if fold_py(k) != 0]
    assert sorted(r["_k"] for r in picked.collect()) == keys


def test_one_row_of_every_group_stays(sp):
    """Ids that stand for several texts, null ids, equal rows."""
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five " * 9, "x y z w v u " * 9)
    rows = [(5, a, "en", "s", 0), (5, b, "en", "s", 0), (9, b, "en", "s", 0), (12, c, "en", "s", 0)]
    rows += [(None, "null id and text " * 9, "en", "s", i % 2) for i in range(3)] + [(12, c, "en", "s", 0)] * 3
    docs = sp.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "2 AS row", "3 AS least", "4 AS _one")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(5, a), (5, b), (12, c), (None, "null id and text " * 9)], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_vectors_with_one_id(sp):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (None, [1.0, 0.0]), (4, [0.0, 0.0])]
    got = multi_index.link_vectors(sp.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([
        (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (None, 0, None, False), (4, 0, 4, True),
    ], key=str)


def test_toxicity_on_held_out_rows(sp):
    docs, labels, truth = toxic_corpus(sp)
    model_ = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs.selectExpr("*", "1 AS score"), model_, evidence=True).collect()}
    held = [i for i in truth if i is not None and fold_py(i) == 0 and truth[i] is not None]
    assert len(held) > 100
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    n = max(got)
    assert got[n]["predicted"] == 1 and got[n - 1]["predicted"] == got[n - 2]["predicted"] == 0
    assert got[n]["evidence"] and not got[n - 1]["evidence"]
    assert all(fold_py(int(e["key"])) != 0 for r in got.values() for e in r["evidence"])
    # Labels of the held-out fold change nothing.
    turned = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(doc_id AS string)), 5) = 0, 1 - toxic, toxic) AS toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, toxicity.train(docs, turned)).collect()}
    assert all(again[i] == got[i]["score"] for i in got)
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.score_texts(docs, None).where("score <> 0").count() == 0
    assert toxicity.score_texts(docs.limit(0), model_).count() == 0
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns


def test_copies_of_toxic_texts_in_rare_words_are_found(sp):
    docs, labels, _ = toxic_corpus(sp, 600)
    rng = random.Random(22)
    rare = [" ".join(f"rare{i}x{rng.randrange(10**6)}" for _ in range(12)) for i in range(10)]
    keys = [i for i in range(5000, 5100) if fold_py(i) != 0][:10]
    more = [(k, t, "en", "s", 0) for k, t in zip(keys, rare)] + [(9000 + i, t, "en", "s", 0) for i, t in enumerate(rare)]
    docs = docs.unionByName(sp.createDataFrame(more, DOCS))
    labels = labels.unionByName(sp.createDataFrame([(k, 1, 1) for k in keys], labels.schema))
    model_ = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs.where("doc_id >= 9000"), model_, evidence=True).collect()}
    assert all(got[9000 + i]["predicted"] == 1 for i in range(10))
    assert all(got[9000 + i]["evidence"][0]["key"] == str(keys[i]) for i in range(10))


def brute_base(text):
    found = WORD.findall(text or "")
    windows = {}
    for i in range(len(found) - 7):
        windows.setdefault(tuple(found[i:i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(found)
    return (n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def test_quality_counts(sp):
    rng = random.Random(15)
    texts = ODD + odd_texts(5) + [words(rng, 60, 3).replace("w1 ", "w1\n") for _ in range(60)] + ["a\n" * 50, " x " * 9, "é b\x0bc\x0cd " * 6]
    got = {r["doc_id"]: r for r in quality.judge(docs_of(sp, texts), None).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(t), t
        assert r["kept"] == (not r["base_failed"])
    assert quality.judge(docs_of(sp, texts).limit(0), None).count() == 0


def test_quality_on_unseen_rows(sp):
    rng = random.Random(16)
    rows, labels = [], []
    for i in range(900):
        text = words(rng, rng.randint(25, 90), 4000)
        good = rng.random() < 0.7
        if not good:
            text = rng.choice([str.upper, lambda t: t.replace(" ", "*** "), lambda t: t.replace(" ", " | ")])(text)
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(good), 0))
    rows += [(900, None, "en", "s", 0)]
    docs = sp.createDataFrame(rows, DOCS)
    model_ = quality.train(docs, sp.createDataFrame(labels[:500] + [(None, 1, 0)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, model_).collect()}
    assert sum(got[i] == bool(labels[i][1]) for i in range(500, 900)) >= 392
    assert got[900] is False
    assert quality.train(docs, sp.createDataFrame(labels, "doc_id long, quality int, toxic int").where("quality = 1")) is None
    assert quality.keep_good(docs, sp.createDataFrame(labels, "doc_id long, quality int, toxic int")).columns == docs.columns


# --- pages ------------------------------------------------------------------------------


@pytest.mark.parametrize("page,text", [
    ('<div class="layout has-sidebar"><article><p>one two</p></article></div>', "one two"),
    ('<div class="page sidebar-right"><main><p>one two</p></main></div>', "one two"),
    ('<div id="page-with-nav"><p>one two</p></div>', "one two"),
    ('<div class="sidebar"><main><p>one two</p></main></div><p>three</p>', "one two three"),
    ('<article><div class="widget-review"><p>one</p></div><section class="share-prices">two</section></article>', "one two"),
    ('<article><p>one</p><video src="x"/><p>two</p></article>', "one two"),
    ('<article><p>one</p><object data=x><p>two</p></article>', "one two"),
    ('<article><p>one</p><canvas><p>two</p><div>three</div></article>', "one two three"),
    ('<article><p>one <video controls><source src="v"><a href="v">no player</a></video> two</p></article>', "one two"),
    ('<nav><main><p>no</p></main></nav><div class="site-header">no</div><div class="comment-list"><p>no</p></div>'
     '<div class="cookie-banner">no</div><div class="ad">no</div><p>yes</p>', "yes"),
    ('<div hidden><article>no</article></div><p>yes</p>', "yes"),
])
def test_markup_of_layouts(page, text):
    assert " ".join(html_main.blocks_of(page)[0]) == text


def test_shared_sentences_stay_in_articles():
    """A quote inside a paragraph stays, a repeated block in the article goes."""
    quote = "this quote of ten words is on many of pages here".split(" ")
    keys = html_main.window_keys(quote, html_main.MIN_RUN)
    blocks = ["before it " + " ".join(quote) + " and after it", " ".join(quote), "other words"]
    text, removed = html_main.strip(blocks, [False, False, False], keys)
    assert text == " ".join([blocks[0], blocks[2]]) and removed == len(quote)
    long = "a b c d e f g h i j k l m n o " + " ".join(quote)
    assert html_main.strip([long], [True], keys)[0] == "a b c d e f g h i j k l m n o"
    assert html_main.strip([long + " p q r"], [True], keys)[0] == long + " p q r"


def test_article_of_a_page(sp):
    page = (
        '<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>'
        '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad --><div class="top ad">Buy</div>'
        '<article><header><h1>T &amp; U</h1></header><p><b>One</b>  two&nbsp;x&#33;<br>three<p>four\n five</p>'
        '<aside>Side</aside><div class="newsletter-box notice">Sign up</div><form>Name <input></form>'
        '<p>six <span class="share">7</span></p><section id="comments"><article class="comment"><p>Nice</p></article></section>'
        '</article><div id="comments">More</div><footer>&copy; me</footer></body></html>'
    )
    rows = [(1, "http://a.example/x", page), (2, None, None), (3, "odd", ""), (4, "http://a.example/y", "<p>plain &lt;b&gt;"), (1, "http://a.example/x", page)]
    df = sp.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS k", "3 AS open")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_main.main_text(df).collect()]
    text = "T & U One two x! three four five six 7"
    assert sorted(got) == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, "plain <b>", 9)]
    assert html_main.main_text(df.limit(0)).count() == 0


def test_closed_and_custom_elements_keep_what_follows():
    for tag in ('<svg class="i"/>', "<math />", '<svg a="/>" b/>', "<video-player>", '<object-x a="1">', "<select-menu>", "<template-y>"):
        blocks, _ = html_main.blocks_of(f"<article><p>one {tag} two</p><p>three</p></article>")
        assert " ".join(blocks) == "one two three", tag
    blocks, _ = html_main.blocks_of('<p>one <svg width="1"><text>no</text></svg> two<script src="a"/>no</script> three</p>')
    assert blocks == ["one two three"]


def test_host_array_removes_templates(sp):
    rng = random.Random(17)
    template = "this site uses small files to remember what you like best"
    bodies = [words(rng, 60, 5000) for _ in range(40)]
    rows = [(i, f"https://H{i % 2}.example/{i}", f"<div>{template}</div><div>{b}</div><div>{template}</div>") for i, b in enumerate(bodies)]
    rows.append((40, "https://h0.example/0?copy", rows[0][2]))
    df = sp.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_main.main_text(df).collect()}
    assert all(got[i]["text"] == bodies[i] for i in range(40)) and got[40]["text"] == bodies[0]
    assert got[0]["removed_tokens"] == 2 * len(template.split())


PAGE = "page_id long, url string, html string"


def test_article_text_meets_the_host_array(sp):
    rng = random.Random(19)
    plea = "sign up today and get our letter every single week for free"
    bodies = [words(rng, 60, 5000) for _ in range(12)]
    rows = [(i, f"http://a.example/{i}", f"<article><p>{b}</p><p>{plea}</p></article>") for i, b in enumerate(bodies)]
    # A teaser card does not take the page's place, and copies keep their text.
    rows.append((12, "http://a.example/12", f"<div><p>{words(rng, 80, 5000)}</p></div><article>card {plea}</article>"))
    rows += [(20 + i, f"http://a.example/0?{i}", rows[0][2]) for i in range(30)]
    got = {r["page_id"]: r for r in html_main.main_text(sp.createDataFrame(rows, PAGE)).collect()}
    assert all(got[i]["text"] == bodies[i] and got[i]["removed_tokens"] == 12 for i in range(12))
    assert got[12]["text"] == rows[12][2].split("<p>")[1].split("</p>")[0] + " card"
    assert all(got[20 + i]["text"] == bodies[0] for i in range(30))


def test_shared_quotes_and_near_copies_keep_their_text(sp):
    rng = random.Random(20)
    quote = words(rng, 30, 5000)
    bodies = [words(rng, 80, 5000) for _ in range(40)]
    for i in (3, 4):
        bodies[i] += " " + quote
    for i in range(10, 25):
        bodies[i] = bodies[9] + f" other{i}"
    rows = [(i, f"http://a.example/{i}", f"<div>{b}</div>") for i, b in enumerate(bodies)]
    got = {r["page_id"]: r["text"] for r in html_main.main_text(sp.createDataFrame(rows, PAGE)).collect()}
    assert [got[i] for i in range(40)] == bodies


def test_shards_change_no_text(sp):
    rng = random.Random(21)
    lines = [words(rng, 9, 5000) for _ in range(6)]
    rows = [
        (i, "odd" if i % 2 else f"http://a.example/{i}",
         "<div>" + words(rng, 50, 5000) + "</div>" + "".join(f"<div>{x}</div>" for x in lines if rng.random() < 0.28))
        for i in range(120)
    ]
    df = sp.createDataFrame(rows, PAGE)
    whole = sorted(map(tuple, html_main.main_text(df).collect()))
    assert sum(r[4] for r in whole) > 100
    for size in (400, 3000):
        assert sorted(map(tuple, html_main.main_text(df, shard_bytes=size).collect())) == whole


def test_repeated_runs_brute_force():
    rng = random.Random(18)
    for _ in range(30):
        pages = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(6)]
        pages.append(list(pages[0]))
        for p, got in zip(pages, html_main.repeated_runs(pages, 4)):
            want = [False] * len(p)
            for i in range(len(p) - 3):
                if any(q != p and p[i:i + 4] in [q[j:j + 4] for j in range(len(q) - 3)] for q in pages):
                    want[i:i + 4] = [True] * 4
            assert got.tolist() == want


def test_calibration_stays_finite_where_classes_separate():
    z = np.concatenate((np.linspace(-30, -2, 200), np.linspace(3, 40, 600)))
    y = np.repeat([0, 1], [200, 600])
    slope, shift = quality._platt(z, y)
    p = 1 / (1 + np.exp(-(slope * z + shift)))
    assert 0 < slope < 10 and 1e-12 < p.min() < 0.01 and 0.99 < p.max() and ((p >= 0.5) == y).mean() > 0.99
    noisy = np.random.default_rng(1).random(800) < 1 / (1 + np.exp(-(0.3 * z - 1)))
    slope, shift = quality._platt(z, noisy.astype(int))
    assert 0.2 < slope < 0.45 and -1.6 < shift < -0.5


def test_quality_model_is_fitted_off_the_driver(sp):
    import tracemalloc

    from pyspark.sql import functions as F

    pool = [f"w{i}" for i in range(5000)]
    docs = sp.createDataFrame(
        [(i, " ".join(pool[(i * 37 + j * (3 + i % 11)) % 5000] for j in range(3000))) for i in range(200)], "doc_id long, text string"
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    tracemalloc.start()
    try:
        model = quality.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 200 texts have about 8 MB of features; the weights take half a megabyte.
    assert model is not None and len(model.weights) == 2 << quality.BITS and peak < 6 << 20
    assert quality.train(docs, labels.withColumn("quality", F.lit(1))) is None
