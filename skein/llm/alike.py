"""Exact search for texts whose sets of word shingles are alike.

Two sets with a Jaccard similarity of at least t share one of the first
n - ceil(t n) + 1 elements of each, in any order that holds for all sets.  So
texts meet under the elements of these prefixes, common shingles last in the
order, and what meets is compared in full.  Nothing is estimated.

Under an element that many texts share, texts are compared with one of them
first.  What is then linked need not be compared again; of all others each
pair is, by bitmaps of the sets that tell for most pairs that they differ in
too much.  The rest is compared in full, each text with its nearest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILES, ROWS_A_FILE, hold, let_go, make_room, settle, settle_counted, small_batches
from .components import components
from .tokens import Tokens

SHINGLE = 5
#: Of ordering shingles, which decides on cost only: one text of so many is
#: looked at, and shingles of so many of these texts are common, but no more.
LOOK, COMMON, MOST_COMMON = 16, 3, 1 << 17
#: Up to so many texts of an element are compared in pairs at once.
SMALL = 24
#: Comparisons of a text with the chosen one of a large element, per round; rounds at most.
TRIES, ROUNDS = 4, 4
#: Rows of ids or keys up to which they go to every task.
BROADCAST_IDS = 1 << 20
#: Bits of a text's bitmap: four for each of its shingles, so many at least and at most.
LEAST_BITS, MOST_BITS = 256, 8192
_BLOCK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PAIR = ["kind", "u", "v", "key", "n", "pos", "part"]
_FORM = "kind bigint, u bigint, v bigint, key bigint, n bigint, pos bigint, part bigint"


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; shorter texts are one shingle."""
    tokens = Tokens(texts)
    words, n = tokens.hashes().view(np.uint64), tokens.n
    starts = np.cumsum(n) - n
    whole = _shingles(words, SHINGLE)  # those that run from text to text are not looked at
    out = []
    for at, k in zip(starts.tolist(), n.tolist(), strict=True):
        out.append(np.unique(whole[at : at + k - SHINGLE + 1] if k >= SHINGLE else _shingles(words[at : at + k], k)))
    return out


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1 if k else 0
    out = np.full(max(n, 0), k, np.uint64)
    for i in range(k if n > 0 else 0):
        out = (out ^ words[i : i + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return out


def least_common(n, share: float):
    """How many elements a set of n has in common with any that is alike."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def _can_be(n, i, m, j, share: float):
    """Whether sets of n and m whose first common elements are in places i and j can be alike."""
    need = np.ceil(share / (1 + share) * (n + m) - 1e-9)
    return 1 + np.minimum(n - i, m - j) - 1 >= need


def _prefixes(common, share: float):
    def run(batches):
        make_room()
        keys, counts = common.value
        for b in batches:
            found, doc, n, pos = [], [], [], []
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                if not len(s):
                    continue
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    s = s[np.lexsort((s, np.where(keys[at] == s, counts[at], 0)))]
                p = len(s) - int(least_common(np.array(len(s)), share)) + 1
                found.append(s[:p])
                doc.append(np.full(p, i))
                n.append(np.full(p, len(s)))
                pos.append(np.arange(p))
            if found:
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate(found).view(np.int64)),
                        *(pa.array(np.concatenate(x).astype(np.int64)) for x in (doc, n, pos)),
                    ],
                    ["key", "doc", "n", "pos"],
                )

    return run


def _all_shingles(batches):
    for b in batches:
        found = shingle_sets(b.column(0))
        yield pa.record_batch([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["key"])


def _sets(batches):
    for b in batches:
        found = [s.tobytes() for s in shingle_sets(b.column(1))]
        yield pa.record_batch([b.column(0), pa.array(found, pa.binary())], ["doc", "set"])


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that many of a part of the texts have."""
    some = rows.where(F.pmod(F.xxhash64(F.lit("look"), "doc"), F.lit(LOOK)) == 0).select("text")
    got = (
        some.mapInArrow(_all_shingles, "key bigint")
        .groupBy("key")
        .agg(F.count("*").alias("c"))
        .where(F.col("c") >= COMMON)
        .orderBy(F.desc("c"), "key")
        .limit(MOST_COMMON)
        .toArrow()
    )
    keys, counts = (np.asarray(got.column(i).combine_chunks()) for i in range(2))
    keys = keys.astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _batch(kind: int, u, v, *rest):
    rest = rest or [np.zeros(len(u), np.int64)] * 4
    return pa.record_batch([pa.array(np.asarray(c, np.int64)) for c in (np.full(len(u), kind), u, v, *rest)], _PAIR)


def _meet(share: float, most: int):
    """Over (key, doc, n, pos, part) sorted by key: pairs of small keys and of large keys' first texts.

    Kind 0: pairs under keys of up to most texts.  Kind 1: rows of larger keys.
    Kind 2: pairs of the first text of a larger key with the others.  Texts of
    one part make no pair.
    """

    def pairs(k, doc, n, pos, part):
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        longest = int(np.diff(np.r_[edge, len(k)]).max())
        for d in range(1, longest):
            i = np.flatnonzero(k[:-d] == k[d:])
            i = i[part[i] != part[i + d]]
            i = i[_can_be(n[i], pos[i], n[i + d], pos[i + d], share)]
            if len(i):
                yield _batch(0, doc[i], doc[i + d])

    def large(head, k, doc, n, pos, part):
        yield _batch(1, doc, doc, k, n, pos, part)
        i = np.flatnonzero((part != head[4]) & _can_be(n, pos, head[2], head[3], share))
        if len(i):
            yield _batch(2, np.full(len(i), head[1]), doc[i])

    def run(batches):
        make_room()
        held, head = None, None
        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(5)]
            if not len(cols[0]):
                continue
            if head is not None:
                n = int(np.searchsorted(cols[0] != head[0], True))
                if n:
                    yield from large(head, *(c[:n] for c in cols))
                cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                head = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            k = cols[0]
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[edge, len(k)])
            done = np.repeat((size <= most) & (size > 1), size)
            done[edge[-1] :] = False
            if done.any():
                yield from pairs(*(c[done] for c in cols))
            for at, n in zip(edge[:-1][size[:-1] > most].tolist(), size[:-1][size[:-1] > most].tolist(), strict=True):
                yield from large([c[at] for c in cols], *(c[at : at + n] for c in cols))
            held = [c[edge[-1] :] for c in cols]
            if size[-1] > most:
                head = [c[0] for c in held]
                yield from large(head, *held)
                held = None
        if held is not None and len(held[0]) > 1:
            yield from pairs(*held)

    return run


def parities(sets: list[np.ndarray]) -> list[np.ndarray]:
    """A bitmap of each set: a bit says whether an odd number of elements falls on it.

    Two bitmaps differ in as many bits as the sets in elements, or in fewer.  The
    halves of a bitmap make the one of half the size.
    """
    out = []
    for s in sets:
        bits = 1 << (min(max(4 * len(s), LEAST_BITS), MOST_BITS).bit_length() - 1)
        odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64))
    return out


def _bitmaps(batches):
    for b in batches:
        sets = shingle_sets(b.column(1))
        maps = pa.array([m.tobytes() for m in parities(sets)], pa.binary())
        yield pa.record_batch([b.column(0), pa.array(list(map(len, sets)), pa.int64()), maps], ["doc", "n", "map"])


def _folded(maps: list[np.ndarray], words: int) -> np.ndarray:
    """The bitmaps as rows of so many words; smaller ones are left out, their rows are 0."""
    out = np.zeros((len(maps), words), np.uint64)
    for i, m in enumerate(maps):
        if len(m) >= words:
            out[i] = np.bitwise_xor.reduce(m.reshape(-1, words), axis=0)
    return out


def _cross(share: float):
    """Over rows as of _meet and their bitmaps: all pairs under a key that are of two parts and can be alike.

    Gives (u, v, far): in how much they differ at least, in thousandths of all they have.
    """

    def solve(_, doc, n, pos, part, maps):
        words = np.array([len(m) for m in maps])
        folded = {w: _folded(maps, w) for w in np.unique(words).tolist()}
        step = max(1, _BLOCK // len(doc))
        for at in range(0, len(doc), step):
            a = slice(at, at + step)
            ok = (part[a, None] != part) & _can_be(n[a, None], pos[a, None], n, pos, share)
            ok &= np.arange(len(doc)) > np.arange(len(doc))[a, None]
            i, j = np.nonzero(ok)
            i += at
            less = np.minimum(words[i], words[j])
            for w, table in folded.items():
                of = np.flatnonzero(less == w)
                for some in np.split(of, range(_BLOCK // w, len(of), _BLOCK // w)):
                    x, y = i[some], j[some]
                    differ = np.bitwise_count(table[x] ^ table[y]).sum(1, dtype=np.int64)
                    both = np.ceil(share / (1 + share) * (n[x] + n[y]) - 1e-9)
                    near = differ <= n[x] + n[y] - 2 * both
                    if near.any():
                        x, y, differ = x[near], y[near], differ[near]
                        far = 1000 * differ // (n[x] + n[y])
                        yield pa.record_batch([pa.array(c) for c in (np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), far)], ["u", "v", "far"])

    def run(batches):
        make_room()
        held = []
        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(5)]
            maps = np.empty(len(cols[0]), object)
            maps[:] = [np.frombuffer(m.as_buffer(), np.uint64) for m in b.column(5)]
            edge = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]) if len(cols[0]) else []
            for at, end in zip(edge, [*edge[1:], len(cols[0])], strict=True):
                if held and held[0][0][0] != cols[0][at]:
                    yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                held.append([c[at:end] for c in (*cols, maps)])
        if held:
            yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _crossing(rows: DataFrame, large: DataFrame, salt: int, share: float) -> DataFrame:
    """(u, v, far): pairs of two parts under the keys of large that can be alike by their bitmaps."""
    ids = _few_rows(large.select("doc").distinct())
    maps = rows.join(ids, "doc", "left_semi").mapInArrow(_bitmaps, "doc bigint, n bigint, map binary")
    met = _dealt(large.join(maps, ["doc", "n"]), salt, "map").mapInArrow(_cross(share), "u bigint, v bigint, far bigint")
    return met.where("u < v").groupBy("u", "v").agg(F.min("far").alias("far"))


def _nearest_first(rows: DataFrame, pairs: DataFrame, links: DataFrame, share: float) -> DataFrame:
    """links and those that pairs (u, v, far) add: each text is compared with its nearest, then what is still of two parts."""
    ends = pairs.select(F.inline(F.array(F.struct(F.col("u").alias("doc"), "v", "far"), F.struct(F.col("v").alias("doc"), F.col("u").alias("v"), "far"))))
    nearest = ends.groupBy("doc").agg(F.min(F.struct("far", "v")).alias("least")).select(F.col("doc").alias("u"), "least.v")
    links = links.unionByName(alike_among(rows, nearest, share))
    parts = _few_rows(components(links))
    for end in ("u", "v"):
        part = parts.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}"))
        pairs = pairs.join(part, end, "left").withColumn(f"part_{end}", F.coalesce(f"part_{end}", end))
    return links.unionByName(alike_among(rows, pairs.where("part_u != part_v"), share))


def _few_rows(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; each is a number or two."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _dealt(rows: DataFrame, salt: int, *more: str) -> DataFrame:
    """Rows by key, those of a key in an order of chance."""
    rows = rows.select("key", "doc", "n", "pos", "part", *more)
    return rows.repartition("key").sortWithinPartitions("key", F.xxhash64(F.lit(salt), "key", "doc"))


def alike_among(rows: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """Those (u, v) of pairs whose shingle sets are alike; rows: (doc, text)."""
    pairs = hold(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    ids = hold(pairs.select(F.explode(F.array("u", "v")).alias("doc")).distinct())
    sets = hold(rows.join(_few_rows(ids), "doc", "left_semi").mapInArrow(_sets, "doc bigint, set binary"))

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= share * (len(x) + len(y) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    near = (
        pairs.join(sets.select(F.col("doc").alias("u"), F.col("set").alias("a")), "u")
        .join(sets.select(F.col("doc").alias("v"), F.col("set").alias("b")), "v")
        .where(alike("a", "b"))
        .select("u", "v")
    )
    near, _ = settle_counted(near, "alike")
    for d in (pairs, ids, sets):
        let_go(d)
    return near


def alike_links(docs: DataFrame, id_col: str, text_col: str, share: float, most: int = SMALL) -> DataFrame:
    """(u, v): links that connect what pairs of texts with a Jaccard similarity of at least share connect.

    Each link is such a pair.  Texts are compared by the sets of their shingles
    of five words, lower-cased; texts without words take no part, nor do null ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(rows))
    keyed = rows.mapInArrow(_prefixes(common, share), "key bigint, doc bigint, n bigint, pos bigint")
    met = hold(_dealt(keyed.withColumn("part", F.col("doc")), 0).mapInArrow(_meet(share, most), _FORM))
    n = met.count()
    files = max(FILES, n // ROWS_A_FILE)
    large = settle(met.where("kind = 1").select("key", F.col("u").alias("doc"), "n", "pos"), "large", files)
    small = settle(met.where("kind = 0").select("u", "v").distinct(), "pairs", files)
    first = settle(_few(met), "first", files)
    let_go(met)
    links = alike_among(rows, small.unionByName(first), share)
    for i in range(1, ROUNDS + 1):
        if large.isEmpty():
            break
        parts = _few_rows(components(links))
        large = large.select("key", "doc", "n", "pos").join(parts, large["doc"] == parts["node"], "left")
        large = large.select("key", "doc", "n", "pos", F.coalesce("component", "doc").alias("part"))
        large = settle(large, "large", files)
        # Keys all of whose texts are of one part are done.
        size = large.groupBy("key", "part").agg(F.count("*").alias("c")).groupBy("key")
        size = size.agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("p"), F.sum("c").alias("c"))
        mixed = hold(size.where("p > 0"))
        todo, held = mixed.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
        if not held:
            break
        large = settle(large.join(_few_rows(mixed.select("key")), "key", "left_semi"), "large", files)
        let_go(mixed)
        if i == ROUNDS or todo <= TRIES * held:
            return _nearest_first(rows, settle_counted(_crossing(rows, large, i, share), "crossing")[0], links, share)
        more = _few(_dealt(large, i).mapInArrow(_meet(share, 0), _FORM))
        links = links.unionByName(alike_among(rows, more, share))
    return links


def _few(met: DataFrame) -> DataFrame:
    """Of the pairs with a large key's first text, some of each text."""
    each = met.where("kind = 2").select("u", "v").distinct()
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u"), "u"))
    return each.withColumn("nth", nth).where(F.col("nth") <= TRIES).select("u", "v")
