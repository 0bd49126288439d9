"""Benchmark decontamination by winnowing.

Of every WINDOW consecutive k-gram hashes the least is kept as a fingerprint, in
documents and in benchmark items alike, so any shared span of K + WINDOW - 1
words shares one.  Fingerprints of both sides meet in a join.  Hits are then
extended: the spans of SPAN words whose fingerprint was hit are joined with the
benchmark's spans in full, and spans that touch become one.

Before the join, documents drop the fingerprints that a filter of bounded size
knows not to be the benchmark's; it may let others pass, but never drops a hit.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, small_batches, worker_cache
from .tokens import LETTERS, Tokens

#: Words of a span that counts.
SPAN = 10
K = 5
WINDOW = SPAN - K + 1
#: Bytes of the filter that goes to every task, at most; and its bits for a fingerprint, if there is room.
FILTER_BYTES = 8 << 20
FILTER_BITS = 32
#: Texts with a hit up to which their keys go to every task, and bytes of what is found in them.
BROADCAST_KEYS, BROADCAST_BYTES = 1 << 20, 16 << 20

_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of each text's words."""
    tokens = Tokens(texts, LETTERS)
    return np.split(tokens.hashes().view(np.uint64), np.cumsum(tokens.n)[:-1]) if len(texts) else []


def gram_hashes(ids: np.ndarray, k: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of each k consecutive ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ ids[j : j + n]) * base
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of so many hashes the position of the least, the last of equal ones."""
    window = max(1, min(window, len(hashes)))
    n = len(hashes) - window + 1
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, window):
        other = hashes[j : j + n]
        less = other <= best
        best = np.where(less, other, best)
        at[less] = np.flatnonzero(less) + j
    return at


class Spans:
    """The spans of texts and their fingerprints."""

    def __init__(self, span: int = SPAN, k: int = K):
        self.span, self.k = span, k

    def of(self, hashes: np.ndarray, m: int, passes=None):
        """(start, fingerprint, two hashes) of each span of m words whose fingerprint passes.

        Spans shorter than self.span are their own fingerprints.
        """
        if len(hashes) < m:
            return (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3)
        if m < self.span:
            print_ = gram_hashes(hashes, m)
            start = np.arange(len(print_)) if passes is None else np.flatnonzero(passes(print_))
            print_ = print_[start]
        else:
            grams = gram_hashes(hashes, self.k)
            at = winnow(grams, m - self.k + 1)
            start = np.arange(len(at))
            if passes is not None:
                kept = at[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])]  # places never fall from window to window
                kept = kept[passes(grams[kept])]
                start = np.flatnonzero(np.isin(at, kept)) if len(kept) else kept
            print_ = grams[at[start]]
        if not len(start):
            return start, print_, print_, print_
        whole = hashes[start[:, None] + np.arange(m)]
        one, two = np.full(len(start), m, np.uint64), np.full(len(start), m, np.uint64)
        for j in range(m):
            one = (one ^ whole[:, j]) * _BASE
            one ^= one >> np.uint64(31)
            two = (two + whole[:, j]) * _OTHER
            two ^= two >> np.uint64(27)
        return start, print_, one, two


class Filter:
    """A Bloom filter over fingerprints: 64-bit words, a power of two of them."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @staticmethod
    def places(h, bits: int):
        """Three bits of each fingerprint; h: a column of signed 64-bit hashes."""
        return [F.shiftrightunsigned(h, n).bitwiseAND(F.lit(bits - 1).cast("bigint")) for n in (0, 20, 38)]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        left = np.arange(len(h))
        for n in (0, 20, 38):
            place = (h[left] >> np.uint64(n)) & self.mask
            left = left[(self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        out = np.zeros(len(h), bool)
        out[left] = True
        return out


def fit_filter(prints: DataFrame, most_bytes: int = FILTER_BYTES) -> Filter:
    """A filter of the fingerprints h of prints; at most most_bytes, and the sum of its words comes to the driver."""
    n = prints.count()
    bits = 1 << 10
    while bits < n * FILTER_BITS and bits < most_bytes * 8:
        bits *= 2
    place = F.explode(F.array(*Filter.places(F.col("h"), bits)))
    got = (
        prints.select(place.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("w").to_numpy()] = got.column("x").to_numpy().astype(np.int64).view(np.uint64)
    return Filter(words)


_SPANS = "item string, m int, h bigint, s1 bigint, s2 bigint"


def _item_spans(span: int, k: int):
    def run(batches):
        spans = Spans(span, k)
        for b in batches:
            for item, words in zip(b.column(0).to_pylist(), words_of(b.column(1)), strict=True):
                m = min(span, len(words))
                if not m:
                    continue
                _, *found = spans.of(words, m)
                n = len(found[0])
                yield pa.record_batch(
                    [
                        pa.array([item] * n, pa.string()),
                        pa.array(np.full(n, m, np.int32)),
                        *(pa.array(x.view(np.int64)) for x in found),
                    ],
                    ["item", "m", "h", "s1", "s2"],
                )

    return run


#: What this worker process needs for documents, for the benchmark used last.
_finders = worker_cache()

_SPAN = pa.struct([("m", pa.int32()), ("h", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("at", pa.list_(pa.int32()))])


def candidates(spans: Spans, passes, lengths: list[int], words: np.ndarray) -> list[dict]:
    """The distinct spans of a text whose fingerprints pass, each with its places."""
    out: dict = {}
    for m in lengths:
        start, *found = spans.of(words, m, passes)
        if len(start):
            rows = zip(*(x.view(np.int64).tolist() for x in found), strict=True)
            for at, key in zip(start.tolist(), rows, strict=True):
                out.setdefault((m, *key), []).append(at)
    return [{"m": m, "h": h, "s1": a, "s2": b, "at": at} for (m, h, a, b), at in out.items()]


def _finder(sc, passes: Filter, lengths: list[int], span: int, k: int):
    held, token = sc.broadcast(passes.words), uuid.uuid4().hex

    @F.arrow_udf("struct<n_words:bigint,spans:array<struct<m:int,h:bigint,s1:bigint,s2:bigint,at:array<int>>>>")
    def find(texts: pa.Array) -> pa.Array:
        if token not in _finders:
            _finders.clear()
            _finders[token] = Spans(span, k), Filter(held.value)
        spans, passes = _finders[token]
        words = words_of(texts)
        found = pa.array([candidates(spans, passes, lengths, w) for w in words], pa.list_(_SPAN))
        return pa.StructArray.from_arrays([pa.array([len(w) for w in words], pa.int64()), found], ["n_words", "spans"])

    return find


def _keys(text_col: str) -> list[Column]:
    """A text's key: 128 bits."""
    return [F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit("second"), text_col).alias("t2")]


class Benchmark:
    """The spans of a benchmark's items, as tables that are never collected."""

    def __init__(self, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, filter_bytes: int = FILTER_BYTES):
        spark = benchmark.sparkSession
        small_batches(spark)
        items = benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col)).where(F.col(item_text_col).isNotNull())
        spans = hold(items.mapInArrow(_item_spans(span, k), _SPANS))
        # A row a distinct span.  Spans of the same items share a set, so that what
        # many items have in common is one row for a document, whatever its length.
        whole = spans.groupBy("m", "s1", "s2").agg(F.sort_array(F.collect_set("item")).alias("items"))
        self.spans = hold(whole.select("m", "s1", "s2", F.xxhash64("items").alias("set1"), F.xxhash64(F.lit("set"), "items").alias("set2"), "items"))
        self.prints = hold(spans.select("h").distinct())
        lengths = sorted(r["m"] for r in spans.select("m").distinct().collect())
        #: Of a text: struct(n_words, spans that may be the benchmark's).
        self.find = _finder(spark.sparkContext, fit_filter(self.prints, filter_bytes), lengths, span, k)

    def leaks(self, found: DataFrame) -> DataFrame:
        """(t1, t2, n_hit, hits, items) of each distinct text with a hit; found: (t1, t2, spans) of texts."""
        found = found.where(F.size("spans") > 0).groupBy("t1", "t2").agg(F.first("spans").alias("spans"))
        found = hold(found).select("t1", "t2", F.explode("spans").alias("x")).select("t1", "t2", "x.*")
        hit = found.join(self.prints, "h", "left_semi")
        hit = hit.join(self.spans.select("m", "s1", "s2", "set1", "set2"), ["m", "s1", "s2"])
        hit = hold(hit.select("t1", "t2", "m", "at", "set1", "set2"))
        # Runs of spans that touch, by the furthest end before each.
        order = Window.partitionBy("t1", "t2").orderBy("start", "end")
        ranges = (
            hit.select("t1", "t2", "m", F.explode(F.col("at").cast("array<bigint>")).alias("start"))
            .withColumn("end", F.col("start") + F.col("m"))
            .withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("run", F.count_if(F.coalesce(F.col("start") > F.col("before"), F.lit(True))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("t1", "t2", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .groupBy("t1", "t2")
            .agg(
                F.sum(F.col("end") - F.col("start")).alias("n_hit"),
                F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"),
            )
        )
        sets = self.spans.groupBy("set1", "set2").agg(F.first("items").alias("items"))
        named = (
            hit.select("t1", "t2", "set1", "set2")
            .distinct()
            .join(sets, ["set1", "set2"])
            .groupBy("t1", "t2")
            .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        )
        return hold(ranges.join(named, ["t1", "t2"]))


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", into: str = "leak", keep: list[str] | None = None, **settings
) -> DataFrame:
    """docs with a column `into`: struct(n_words, n_hit, hits, items); one of that name is replaced.

    hits: ranges of words (start, end) that lie in an occurrence of a window
    (span consecutive words of an item; a shorter item is one window).  items:
    ids, as sorted distinct strings, of items with an occurring window; rows of
    the benchmark that repeat an id are one item.  Null and empty texts have no
    words; null items and items without words match nothing; an item without an
    id marks words but is not named.  Rows that repeat a text get what it gets.
    Words are told apart by 64-bit hashes, spans and texts by 128 bits.

    The benchmark is never collected: its fingerprints are joined with those of
    the documents that a filter of filter_bytes at most lets through.  Of what
    is found, up to BROADCAST_BYTES go to every task; more is joined by shuffling.
    Texts are read once and held on disk with the columns to keep, all by default.
    """
    index = Benchmark(benchmark, **settings)
    tag = uuid.uuid4().hex  # no column of docs has such a name
    t1, t2, read, what = (f"{x}_{tag}" for x in ("t1", "t2", "read", "found"))
    one, two = _keys(text_col)
    kept = [c for c in (docs.columns if keep is None else keep) if c != into]
    rows = hold(docs.select(*kept, one.alias(t1), two.alias(t2), index.find(F.col(text_col)).alias(read)))
    found = index.leaks(rows.select(F.col(t1).alias("t1"), F.col(t2).alias("t2"), F.col(f"{read}.spans").alias("spans")))
    found = found.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.struct("n_hit", "hits", "items").alias(what))
    size = 64 + 16 * F.size(f"{what}.hits") + F.aggregate(f"{what}.items", F.lit(0), lambda n, x: n + F.octet_length(x) + 8)
    size = found.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    got = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, [t1, t2], "left")
    none = {"n_hit": F.lit(0).cast("bigint"), "hits": F.array().cast("array<struct<start:bigint,end:bigint>>"), "items": F.array().cast("array<string>")}
    parts = [F.coalesce(f"{what}.{name}", empty).alias(name) for name, empty in none.items()]
    return got.select(*kept, F.struct(F.col(f"{read}.n_words").alias("n_words"), *parts).alias(into))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs without a hit word, all columns."""
    index = Benchmark(benchmark, **settings)
    found = docs.select(*_keys(text_col), index.find(F.col(text_col)).alias("read")).select("t1", "t2", "read.spans")
    found = index.leaks(found).select("t1", "t2")
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    one, two = _keys(text_col)
    return docs.join(found, (one == found["t1"]) & (two == found["t2"]), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bx AS (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bx)),
lens AS (SELECT DISTINCT m FROM win),
dg AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
hit AS (SELECT dg.doc_id, dg.i, dg.m, win.item_id FROM dg JOIN win ON dg.m = win.m AND dg.g = win.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
