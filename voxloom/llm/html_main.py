"""Main text of web pages: a host's suffix array over its pages' blocks, with markup as evidence.

A page is cut into text blocks. Text that markup calls navigation, footer,
aside, form, script, advert, notice or comment list is dropped. All other
blocks, in an article or not, are put to their host: near-equal pages are
collapsed to one, the token streams of the host's pages meet in suffix arrays,
and stretches of at least ``MIN_RUN`` tokens on a large enough share of its
distinct pages are removed. Unique runs stay, and so does text that copies of a
page, or a few pages that quote it, share.

A large host has several suffix arrays. A stretch on enough pages of the host is
on its share of them in one array at least, so the arrays name the candidates
and their pages are then counted over the whole host.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from voxloom.session import materialise
from voxloom.llm.common import components, private, worker_cache

# Tokens a repeated stretch has at least.
MIN_RUN = 6
# Distinct pages of the host, and share of them, that a repeated stretch is on at least.
MIN_PAGES = 4
MIN_SHARE = 0.3
# Page bytes of one suffix array, about: a host with more is dealt to several.
SHARD_BYTES = 4_000_000
# Word orders of a page's sketch, and how many agree for near copies.
SKETCH = 64
ALIKE = 57

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    # Only foreign elements can close themselves: HTML ignores the slash elsewhere.
    r"|<(?:svg|math)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>"
    r"|<(script|style|noscript|template|svg|math|iframe|textarea)(?=[\s/>])"
    r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|$)"
    # What browsers show in place of media: only where the element is closed before the page goes on.
    r"|<(?P<media>object|canvas|audio|video)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
    r"(?:(?!<(?:(?P=media)|article|main|section|div|h[1-6])\b).)*?</(?P=media)\s*>"
    r"|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
_CHROME = frozenset("head title nav header footer aside form button menu dialog select option".split())
_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split()
)
# A class or id as a whole: what it names, where it stands, what holds it. Words
# of a layout ("has-sidebar", "page-with-nav") or of a subject ("share-prices") do not match.
_MARK = re.compile(
    r"(?:(?:site|page|main|global|primary|secondary|top|bottom|left|right|post|entry)[-_])?"
    r"(?:ads?|adverts?|advert\w+|sponsor(?:ed|s|ship)?|promos?|promotion|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|"
    r"subscription|share|sharing|social|related|recommend(?:ed|ations?)|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|header|masthead|comments?|disqus|respond|popup|modal|toolbar|pagination|pager|widgets?|skip-link)"
    r"(?:[-_](?:ads?|area|banner|bar|block|body|box|buttons?|container|content|form|icons?|inner|item|items|links?|list|menu|nav|notice|"
    r"popup|posts?|section|slot|text|thread|unit|widget|wrap|wrapper|top|bottom|\d+))*",
    re.I,
)
# An article's own head holds its title, so there these two are content.
_IN_ARTICLE = frozenset(("header",))


# How an element is marked: by its class or id, or by what it is.
_BY_CLASS, _BY_KIND = 1, 2


def _boilerplate(name: str, attributes: str, in_article: bool) -> int:
    if name in _CHROME:
        return 0 if in_article and name in _IN_ARTICLE else _BY_KIND
    if name in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return 0
    if not attributes or "=" not in attributes:
        return _BY_KIND if attributes and " hidden" in f" {attributes.lower()} " else 0
    for a in _ATTRIBUTE.finditer(attributes):
        key = a.group(1).lower()
        value = a.group(2) or a.group(3) or a.group(4) or ""
        if key == "role" and value.lower() in _ROLES:
            return _BY_KIND
        if key in ("class", "id") and any(_MARK.fullmatch(w) for w in value.split()):
            return 0 if in_article and name in _INLINE else _BY_CLASS
        if key == "aria-hidden" and value.lower() == "true":
            return _BY_KIND
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return _BY_KIND
    return 0


def blocks_of(page: str) -> tuple[list[str], list[bool]]:
    """Text blocks in page order without marked boilerplate, and which are in the
    page's article: evidence for ``strip``.

    Unclosed elements end with the element around them; ``main`` counts as the
    article of pages without one.
    """
    blocks: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, boilerplate, article depth before
    drop = 0
    begun = False  # an article or main was seen
    article = 0  # 2: in an article, 1: in main
    at = 0

    def close() -> None:
        nonlocal held
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append(text)
                kinds.append(article)
            held = []

    for m in _TOKEN.finditer(page):
        if m.start() > at and not drop:
            held.append(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if any(s[0] == name for s in stack):
                if name not in _INLINE:
                    close()
                while stack:
                    top, marked, before = stack.pop()
                    drop -= marked > 0
                    if top not in _INLINE:
                        close()
                    article = before
                    if top == name:
                        break
            elif name not in _INLINE and not drop:
                close()
            continue
        attributes = m["rest"]
        if name not in _INLINE and not drop:
            close()
        if name in _VOID or attributes.endswith("/"):
            continue
        # A new paragraph or item ends an open one.
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            drop -= stack.pop()[1] > 0
        marked = _boilerplate(name, attributes, article == 2)
        if name in ("article", "main") and not marked and not begun:
            begun = True
            if drop and max(m for _, m, _ in stack) == _BY_CLASS:
                # What holds the page's text is its layout, whatever its class says.
                stack = [(n, 0, before) for n, _, before in stack]
                drop = 0
        marked = max(marked, max((m for _, m, _ in stack), default=0)) if drop else marked
        stack.append((name, marked, article))
        drop += marked > 0
        if name == "article" and not drop:
            article = 2
        elif name == "main" and not drop and article < 2:
            article = 1
    if at < len(page) and not drop:
        held.append(page[at:])
    close()
    most = max(kinds, default=0)
    return blocks, [k == most and k > 0 for k in kinds]


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` tokens or more, and their ranks.

    Prefix doubling: each round orders suffixes by pairs of ranks, which doubles
    the tokens compared. Suffixes alike to that depth share a rank.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    done = 1
    while done < depth:
        step = min(done, depth - done)
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-step] = rank[step:]
        _, rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        done += step
    order = np.argsort(rank, kind="stable")
    return order, rank


def window_keys(tokens: list[str], width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` tokens, equal in all processes."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    number: dict[str, int] = {}
    at = np.array([number.setdefault(t, len(number)) for t in tokens])
    own = np.array([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in number], dtype=np.uint64)[at]
    key = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + own[i:i + n]
        key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a window of ``width`` beginning at one of ``starts``."""
    edge = np.zeros(n + width + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0


def window_pages(pages: list[list[str]], groups: list[int], width: int) -> list[np.ndarray]:
    """For each page's tokens, on how many groups of pages the window that begins
    there occurs, by one suffix array over all pages (0 where none fits)."""
    counts = np.array([len(p) for p in pages], dtype=np.int64)
    if not counts.sum():
        return [np.zeros(0, dtype=np.int64) for _ in pages]
    number: dict[str, int] = {}
    # A separator of its own ends each page, so no stretch crosses pages.
    flat: list[int] = []
    for i, page in enumerate(pages):
        flat += [number.setdefault(t, len(number)) for t in page]
        flat.append(-1 - i)
    tokens = np.array(flat, dtype=np.int64)
    group = np.repeat(np.array(groups, dtype=np.int64), counts + 1)
    order, rank = suffix_array(tokens, width)
    # Distinct groups per rank: first suffix of each (rank, group).
    by = order[np.lexsort((group[order], rank[order]))]
    fresh = np.ones(len(by), dtype=bool)
    fresh[1:] = (rank[by][1:] != rank[by][:-1]) | (group[by][1:] != group[by][:-1])
    found = np.bincount(rank[by], weights=fresh).astype(np.int64)[rank]
    ends = np.cumsum(counts + 1)
    out = []
    for e, n in zip(ends.tolist(), counts.tolist()):
        own = found[e - n - 1:e - 1].copy()
        own[max(0, n - width + 1):] = 0
        out.append(own)
    return out


def repeated_runs(pages: list[list[str]], min_run: int = MIN_RUN, least: int = 2) -> list[np.ndarray]:
    """For each page's tokens, which lie in a stretch of ``min_run`` tokens or
    more that occurs on ``least`` pages or more with different token streams."""
    # Equal pages are one: copies do not make their text boilerplate.
    same: dict[tuple, int] = {}
    groups = [same.setdefault(tuple(p), i) for i, p in enumerate(pages)]
    return [
        covered(np.flatnonzero(n >= least), len(p), min_run)
        for p, n in zip(pages, window_pages(pages, groups, min_run))
    ]


def least_pages(pages):
    """Distinct pages a stretch is on at least, on a host of so many."""
    return np.maximum(MIN_PAGES, np.ceil(np.asarray(pages) * MIN_SHARE - 1e-9)).astype(np.int64)


# Odd factors and addends of the word orders whose first words make a sketch.
_FACTORS, _ADDENDS = (np.random.default_rng(10).integers(0, 2**63, (2, SKETCH), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))


def sketch(tokens: list[str]) -> tuple[bytes, list[int]]:
    """A byte per word order, alike for as large a share of them as of the words
    of two pages, and keys of runs of eight orders, one equal for near copies."""
    if not tokens:
        return b"\0" * SKETCH, []
    h = np.array([zlib.crc32(t.encode()) for t in set(tokens)], dtype=np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    low = np.full(SKETCH, 2**32 - 1, dtype=np.uint64)
    for at in range(0, len(h), 4096):
        low = np.minimum(low, ((h[at:at + 4096, None] * _FACTORS + _ADDENDS) >> np.uint64(32)).min(axis=0))
    low = low.astype("<u4")
    bands = [
        int.from_bytes(hashlib.blake2b(bytes([i]) + low[i:i + 8].tobytes(), digest_size=8).digest(), "little", signed=True)
        for i in range(0, SKETCH, 8)
    ]
    return low.astype(np.uint8).tobytes(), bands


def near_pages(streams: DataFrame) -> DataFrame:
    """(node, root) of the page streams that have near copies on their host.

    ``streams``: (node, host, sketch, bands), one row per stream. Streams that
    share a band are compared with the band's smallest; links are followed.
    """
    banded = streams.select("node", F.explode("bands").alias("b"), "host").select(
        "node", F.xxhash64("host", "b").alias("b")
    )
    heads = banded.groupBy("b").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = banded.join(heads, "b").where("node <> head").select("node", "head").distinct()
    own = streams.select("node", F.col("sketch").alias("x"))
    both = pairs.join(own, "node").join(own.select(F.col("node").alias("head"), F.col("x").alias("y")), "head")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (
                np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH) for c in ("x", "y")
            )
            keep = pa.array((x == y).sum(axis=1) >= ALIKE)
            yield pa.RecordBatch.from_arrays([b.column("node").filter(keep), b.column("head").filter(keep)], names=["node", "head"])

    links = materialise(both.select("node", "head", "x", "y").mapInArrow(alike, "node long, head long"), "near")
    return components(links, "node", "head")


def main_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(key, url, ``text``, ``n_chars``, ``removed_tokens``) of every page.

    Null and empty pages have an empty text. Character references are decoded,
    white space in a block becomes one blank, blocks are joined by one blank.
    Rows with equal keys are pages of their own; pages with a null or odd url
    are one host; other columns are ignored; an empty table gives no rows.
    ``shard_bytes`` moves work between tasks and changes no result.
    """
    kind = pages.schema[key].dataType.simpleString()
    name = private(pages, "html")
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("url"), host.alias("host"), F.col(f"`{body}`").alias(name)
    )
    # Only hosts of more than one shard: a row per ``shard_bytes`` of input at most.
    large = rows.groupBy("host").agg(
        F.ceil(F.sum(F.octet_length(name)) / F.lit(float(shard_bytes))).cast("int").alias("shards")
    ).where("shards > 1")
    large = materialise(large, "hosts")
    kinds = f"k {kind}, url string, host string"

    def streams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for page in b.column(1).to_pylist():
                tokens = " ".join(blocks_of(page or "")[0]).split(" ")
                got.append((_stream(tokens), *sketch(tokens)) if tokens != [""] else (0, b"\0" * SKETCH, []))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()),
                 pa.array([g[2] for g in got], pa.list_(pa.int64()))], names=["host", "stream", "sketch", "bands"],
            )

    found = rows.select("host", name).mapInArrow(streams_of, "host string, stream long, sketch binary, bands array<bigint>")
    streams = materialise(
        found.where("stream <> 0").groupBy("host", "stream").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
        .select(F.xxhash64("host", "stream").alias("node"), "host", "stream", "sketch", "bands"),
        "streams",
    )
    rooted = streams.select("node", "host", "stream").join(near_pages(streams), "node", "left").select(
        "host", "stream", F.coalesce("root", "node").alias("root"), (F.coalesce("root", "node") == F.col("node")).alias("head")
    )
    rooted = materialise(rooted, "roots")
    sizes = materialise(rooted.where("head").groupBy("host").agg(F.count("*").alias("pages")), "sizes")
    by_host = F.broadcast(large)

    def sharded(df):
        return df.join(by_host, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn(
            "shard", F.pmod("stream", "shards").cast("int")
        )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed, outside, stream = [], [], []
            for page in b.column(3).to_pylist():
                blocks, sure = blocks_of(page or "")
                # Blocks hold no line ends.
                packed.append(_codec()[0].compress("\n".join(blocks).encode()))
                outside.append([any(sure) and not s for s in sure])
                stream.append(_stream(" ".join(blocks).split(" ")) if blocks else 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(packed, pa.binary()),
                 pa.array(outside, pa.list_(pa.bool_())), pa.array(stream, pa.int64())],
                names=["k", "url", "host", "packed", "outside", "stream"],
            )

    parsed = rows.mapInArrow(parse, f"{kinds}, packed binary, outside array<boolean>, stream long")
    marks = sharded(rooted.join(sizes, "host")).select("host", "shard", "stream", "root", "head", "pages")

    def first_look(texts: pa.Table, known: pa.Table) -> pa.Table:
        """Decides a host of one shard; of others, lists windows that may be on
        enough pages: some shard holds its share of any that is."""
        blocks = [unpack(x) for x in texts.column("packed").to_pylist()]
        tokens = [[t for x in own for t in x.split(" ")] for own in blocks]
        n = len(tokens)
        stream = texts.column("stream").to_pylist()
        root = dict(zip(known.column("stream").to_pylist(), zip(known.column("root").to_pylist(), known.column("head").to_pylist())))
        shards = texts.column("shards")[0].as_py() if n else 1
        total = known.column("pages")[0].as_py() if known.num_rows else 0
        least = int(least_pages(total))
        # Only the head of a group of near copies counts.
        heads = list({s: i for i, s in enumerate(stream) if s in root and root[s][1]}.values())
        counts = window_pages([tokens[i] for i in heads], list(range(len(heads))), MIN_RUN)
        wanted = -(-least // shards)
        keys = [window_keys(tokens[i], MIN_RUN)[own[:max(0, len(tokens[i]) - MIN_RUN + 1)] >= wanted] for i, own in zip(heads, counts)]
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
        head = np.zeros(n, dtype=bool)
        head[heads] = True
        if shards == 1:
            done = [strip(own, out, keys) for own, out in zip(blocks, texts.column("outside").to_pylist())]
            none = pa.nulls(n, pa.binary())
            return pa.table({
                "k": texts.column("k"), "url": texts.column("url"), "host": texts.column("host"),
                "text": pa.array([d[0] for d in done], pa.string()), "removed": pa.array([d[1] for d in done], pa.int64()),
                "packed": none, "outside": pa.nulls(n, pa.list_(pa.bool_())), "head": pa.array(head),
                "least": pa.array([least] * n, pa.int64()), "maybe": pa.nulls(n, pa.list_(pa.int64())),
            })
        maybe = [None] * n
        if n:
            maybe[0] = keys.tolist()
        return pa.table({
            "k": texts.column("k"), "url": texts.column("url"), "host": texts.column("host"),
            "text": pa.nulls(n, pa.string()), "removed": pa.nulls(n, pa.int64()),
            "packed": texts.column("packed").cast(pa.binary()), "outside": texts.column("outside"), "head": pa.array(head),
            "least": pa.array([least] * n, pa.int64()), "maybe": pa.array(maybe, pa.list_(pa.int64())),
        })

    looked = materialise(
        sharded(parsed).groupBy("host", "shard").cogroup(marks.groupBy("host", "shard")).applyInArrow(
            first_look,
            f"{kinds}, text string, removed long, packed binary, outside array<boolean>, head boolean, least long, maybe array<bigint>",
        ),
        "looked",
    )
    spark = pages.sparkSession
    result = looked.where("packed is null").select("k", "url", "text", "removed")
    if not large.isEmpty():
        result = result.unionByName(_large_hosts(spark, looked.where("packed is not null"), kind))
    return result.select(
        F.col("k").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"),
        F.col("removed").alias("removed_tokens"),
    )


def _large_hosts(spark, looked: DataFrame, kind: str) -> DataFrame:
    """Texts of hosts of several shards: candidates counted over the whole host."""
    maybe = spark.sparkContext.broadcast(_by_host(looked.where("maybe is not null").select("host", F.explode("maybe").alias("w")).distinct()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[np.ndarray]] = {}
            for host, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = np.unique(window_keys([t for own in unpack(x) for t in own.split(" ")], MIN_RUN))
                seen.setdefault(host, []).append(keys[np.isin(keys, maybe.value.get(host, keys[:0]))])
            for host, all_ in seen.items():
                keys, n = np.unique(np.concatenate(all_), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64)),],
                    names=["host", "w", "n"],
                )

    least = looked.groupBy("host").agg(F.max("least").alias("least"))
    counts = looked.where("head").select("host", "packed").mapInArrow(count, "host string, w long, n long")
    often = counts.groupBy("host", "w").agg(F.sum("n").alias("n")).join(least, "host").where("n >= least").select("host", "w")
    repeated = spark.sparkContext.broadcast(_by_host(often))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        for b in batches:
            done = [
                strip(unpack(x), out, repeated.value.get(host, none))
                for host, x, out in zip(*(b.column(c).to_pylist() for c in ("host", "packed", "outside")))
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
                names=["k", "url", "text", "removed"],
            )

    return looked.select("k", "url", "host", "packed", "outside").mapInArrow(
        decide, f"k {kind}, url string, text string, removed long"
    )


def _by_host(windows: DataFrame) -> dict[str, np.ndarray]:
    got: dict[str, list[int]] = {}
    for host, w in zip(*windows.toArrow().to_pydict().values()):
        got.setdefault(host, []).append(w)
    return {h: np.unique(np.array(w, dtype=np.int64)) for h, w in got.items()}


def _stream(tokens: list[str]) -> int:
    """A number of the token stream, never 0."""
    return int.from_bytes(hashlib.blake2b(" ".join(tokens).encode(), digest_size=8).digest(), "little", signed=True) or 1


def _codec() -> tuple:
    return worker_cache(("zstd pages",), lambda: (zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()))


def unpack(packed: bytes) -> list[str]:
    text = _codec()[1].decompress(packed).decode()
    return text.split("\n") if text else []


def strip(blocks: list[str], outside: list[bool], repeated: np.ndarray) -> tuple[str, int]:
    """The page's text without repeated stretches, and the tokens removed.

    Markup is evidence: a block outside the page's article goes as a whole where
    half of it is repeated, and else loses what is repeated at its borders. In
    the article a block goes if all of it is repeated, and loses its repeated
    borders if half of it is: a sentence that articles share stays where it stands.
    """
    parts = [x.split(" ") for x in blocks]
    tokens = [t for own in parts for t in own]
    if not len(repeated):
        return " ".join(tokens), 0
    found = covered(np.flatnonzero(np.isin(window_keys(tokens, MIN_RUN), repeated)), len(tokens), MIN_RUN)
    gone = np.zeros(len(tokens), dtype=bool)
    at = 0
    for own, out in zip(parts, outside):
        here = found[at:at + len(own)]
        if here.all() or (out and 2 * here.sum() >= len(own)):
            gone[at:at + len(own)] = True
        elif 2 * here.sum() >= len(own) or out:
            stay = np.flatnonzero(~here)
            gone[at:at + stay[0]] = gone[at + stay[-1] + 1:at + len(own)] = True
        at += len(own)
    return " ".join(t for t, g in zip(tokens, gone.tolist()) if not g), int(gone.sum())
