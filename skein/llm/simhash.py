"""SimHash near-dedup on deletion-variant signatures.

Fingerprints that differ in at most four bits differ in at most one bit of one
of three segments.  So every fingerprint is indexed under each of its segments
with one bit wiped out; fingerprints that meet under a key are compared in
full.  Links become components whose least document stays.
"""

from __future__ import annotations

import itertools
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alike import alike_links
from .common import hold, make_room, settle_counted, small_batches
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Texts are near copies if their sets of five-word shingles are as alike.
JACCARD = 0.8
#: What callers that still ask for copies by their word sets give; see near_components.
WORD_BITS = 5
#: (offset, width) of the segments: MAX_BITS differing bits leave at most one
#: in some segment, as three segments with two each would make six.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A key with more fingerprints is indexed again on its other bits.
MAX_BUCKET = 1 << 16
#: Up to so many fingerprints of a key are compared by offsets, more by search.
SMALL_BUCKET = 24
#: Of a key with more pairs, only those that connect something become links.
FEW_PAIRS = 3
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over word 4-shingles, repeats included; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[min(SHINGLE, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest, seeds = xxhash.xxh64_intdigest, itertools.repeat(SEED)
    for at in range(0, n, _CHUNK):
        cuts = map(slice, starts[at : min(n, at + _CHUNK)].tolist(), ends[at : at + _CHUNK].tolist())
        h = np.fromiter(map(digest, map(joined.__getitem__, cuts), seeds), np.uint64, min(_CHUNK, n - at))
        ones += _ones(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of h have each bit set."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # sums of 255 bits fit a byte
        out += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; null texts have no words."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def all_of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), all_of(F.col(text_col)).alias("fp"))


def _keyed(reps: DataFrame) -> DataFrame:
    """(key, bit, fp, rep, chk): a row for each wiped-out bit.

    bit is the wiped bit.  The key holds it, and the segment's other bits.
    """
    case = lambda values: (
        F.when(F.col("bit") < SEGMENTS[1][0], F.lit(values[0]))
        .when(F.col("bit") < SEGMENTS[2][0], F.lit(values[1]))
        .otherwise(F.lit(values[2]))
    )
    masks = [((1 << w) - 1) << o for o, w in SEGMENTS]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    kept = F.col("fp").bitwiseAND(case(masks)).bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)")))
    return reps.select("fp", "rep", "chk", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(
        F.xxhash64("bit", kept).alias("key"), "bit", "fp", "rep", "chk"
    )


def _keyed_again(rows: DataFrame) -> DataFrame:
    """Variants of a hot key's rows on the bits outside its segment."""

    def cuts(segment: int) -> list[tuple[int, int]]:
        """(bit, mask of the sub-segment that holds it) for the other bits."""
        o, w = SEGMENTS[segment]
        rest = [b for b in range(64) if not o <= b < o + w]
        third = -(-len(rest) // 3)
        parts = [rest[i : i + third] for i in range(0, len(rest), third)]
        signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
        return [(b, signed(sum(1 << x for x in part))) for part in parts for b in part]

    tables = [
        F.array(*[F.struct(F.lit(b).alias("b"), F.lit(m).cast("bigint").alias("m")) for b, m in cuts(s)])
        for s in range(3)
    ]
    table = F.when(F.col("bit") < SEGMENTS[1][0], tables[0]).when(
        F.col("bit") < SEGMENTS[2][0], tables[1]
    ).otherwise(tables[2])
    return rows.select("key", "fp", "rep", "chk", F.explode(table).alias("c")).select(
        F.xxhash64(
            "key", F.col("c.b"), F.expr("fp & c.m & ~shiftleft(1L, c.b)")
        ).alias("key"),
        F.col("c.b").alias("bit"),
        "fp",
        "rep",
        "chk",
    )


def links_of_run(fps: np.ndarray, near) -> list[tuple[int, int]]:
    """Index pairs that join what can be joined among fps: a spanning forest.

    near(i, js) tells which of js are near i.  A breadth-first search from the
    least index on: each reached fingerprint is compared with those not reached
    yet, so a dense group costs little more than one pass, and rows that come
    in the same order under many keys give the same links under all of them.
    """
    left = np.arange(len(fps))
    out = []
    while len(left) > 1:
        todo, left = deque([left[0]]), left[1:]
        while todo and len(left):
            at = todo.popleft()
            hits = near(at, left)
            if hits.any():
                hit = left[hits]
                out += [(at, x) for x in hit.tolist()]
                todo += hit.tolist()
                left = left[~hits]
    return out


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs (u, v) connect something that earlier pairs do not."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    keep = np.zeros(len(u), bool)
    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            keep[i] = True
    return keep


def _linker(max_bits: int, check_bits: int, max_bucket: int | None):
    """Over rows sorted by key: links (kind 0), and rows of too large keys (kind 1)."""
    names = ["kind", "u", "v", "key", "bit", "chk"]

    def batch(kind, u, v, *rest):
        rest = rest or [np.zeros(len(u), np.int64)] * 3
        return pa.record_batch([pa.array(np.asarray(c, np.int64)) for c in (np.full(len(u), kind), u, v, *rest)], names)

    def solve(k, f, r, c):
        """Links among the whole keys of a block."""
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[edge, len(k)])
        us, vs, of = [], [], []
        per_row = np.repeat(size, size)
        group = np.repeat(np.arange(len(size)), size)
        small = (per_row > 1) & (per_row <= SMALL_BUCKET)
        for d in range(1, SMALL_BUCKET):
            i = np.flatnonzero(small[:-d] & (k[:-d] == k[d:]) & (per_row[:-d] > d))
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= max_bits]
            i = i[np.bitwise_count(c[i] ^ c[i + d]) <= check_bits]
            us.append(r[i])
            vs.append(r[i + d])
            of.append(group[i])
        if us:
            # Of a key with many pairs, those that connect: the least ends first.
            u, v, of = (np.concatenate(x) for x in (us, vs, of))
            many = np.bincount(of, minlength=len(size))[of] > FEW_PAIRS
            at = np.flatnonzero(many)
            at = at[np.lexsort((v[at], u[at], of[at]))]
            keep = ~many
            for part in np.split(at, np.flatnonzero(np.diff(of[at])) + 1):
                keep[part] = forest(u[part], v[part])
            us, vs = [u[keep]], [v[keep]]
        for at, n in zip(edge[size > SMALL_BUCKET], size[size > SMALL_BUCKET], strict=True):
            ff, cc = f[at : at + n], c[at : at + n]
            near = lambda i, js: (
                (np.bitwise_count(ff[js] ^ ff[i]) <= max_bits) & (np.bitwise_count(cc[js] ^ cc[i]) <= check_bits)  # noqa: B023
            )
            found = links_of_run(ff, near)
            if found:
                pairs = np.array(found)
                us.append(r[at + pairs[:, 0]])
                vs.append(r[at + pairs[:, 1]])
        if us:
            yield batch(0, np.concatenate(us), np.concatenate(vs))

    def run(batches):
        make_room()
        held = None  # the rows of the last key so far
        large = None  # a key that goes on to the next round
        for b in batches:
            k, bit, f, r, c = (np.asarray(b.column(i)) for i in range(5))
            f, c = f.view(np.uint64), c.view(np.uint64)
            if large is not None:
                n = int(np.searchsorted(k != large, True))
                yield batch(1, f[:n].view(np.int64), r[:n], k[:n], bit[:n], c[:n].view(np.int64))
                k, bit, f, r, c = k[n:], bit[n:], f[n:], r[n:], c[n:]
                if not len(k):
                    continue
                large = None
            if held is not None:
                k, bit, f, r, c = (np.concatenate(x) for x in zip(held, (k, bit, f, r, c), strict=True))
            cut = len(k) - int(np.searchsorted(k[::-1] != k[-1], True))
            if cut:
                yield from solve(k[:cut], f[:cut], r[:cut], c[:cut])
            held = k[cut:], bit[cut:], f[cut:], r[cut:], c[cut:]
            if max_bucket and len(held[0]) > max_bucket:
                large = held[0][0]
                yield batch(1, held[2].view(np.int64), held[3], held[0], held[1], held[4].view(np.int64))
                held = None
        if held is not None and len(held[0]):
            yield from solve(held[0], held[2], held[3], held[4])

    return run


def fingerprint_links(
    reps: DataFrame, max_bits: int = MAX_BITS, check_bits: int = 64, max_bucket: int = MAX_BUCKET
) -> DataFrame:
    """(u, v): links that connect what pairs of (fp, rep, chk) rows connect.

    A pair is linked if its fp differ in at most max_bits bits and its chk in
    at most check_bits; u and v are rep values.  Keys of more than max_bucket
    rows are cut again on their remaining bits, on which the same argument
    about three segments holds; no pair is lost.
    """
    if max_bits > 5:
        raise ValueError("three segments find at most five differing bits")
    form = "kind bigint, u bigint, v bigint, key bigint, bit bigint, chk bigint"

    def solved(keyed, limit):
        keyed = keyed.select("key", F.col("bit").cast("bigint"), "fp", "rep", "chk")
        # The least document of a key comes first, so keys of one group give like links.
        dealt = keyed.repartition("key").sortWithinPartitions("key", "rep")
        # The result is small; the shuffle behind it is not, and goes with what was held.
        return settle_counted(dealt.mapInArrow(_linker(max_bits, check_bits, limit), form), "links")[0]

    found = solved(_keyed(reps), max_bucket)
    links = found.where("kind = 0").select("u", "v")
    more = found.where("kind = 1").select(
        F.col("u").alias("fp"), F.col("v").alias("rep"), "chk", "key", F.col("bit").cast("int").alias("bit")
    )
    if not more.isEmpty():
        again = solved(_keyed_again(more), None)
        links = links.unionByName(again.where("kind = 0").select("u", "v"))
    return links


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = MAX_BITS,
    word_bits: int | None = None,
    jaccard: float | None = None,
) -> DataFrame:
    """(doc_id, fp, component_id) of each row.

    Rows whose fingerprints differ in at most max_bits bits are linked;
    component_id is the smallest id that links lead to, the row's own included.
    Texts without words share fingerprint 0 and are linked like others.  Rows
    that repeat an id are one node.  A null id takes part in no search: its row
    gets the component of its fingerprint, or null if no row with an id has it.

    With jaccard, all rows are linked as well whose sets of five-word shingles
    have at least that similarity, whatever the kind of edit; nothing else is.
    word_bits, which once linked by fingerprints of word sets alone, stands for
    the similarity JACCARD.
    """
    if jaccard is None and word_bits is not None:
        jaccard = JACCARD
    rows = hold(fingerprints(docs, id_col, text_col))
    reps = hold(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = fingerprint_links(reps.withColumn("chk", F.lit(0).cast("bigint")), max_bits)
    if jaccard is not None:
        # These links name documents; each goes with the least of its fingerprint.
        links = links.unionByName(alike_links(docs, id_col, text_col, jaccard)).unionByName(
            rows.join(reps, "fp").where("rep < doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
        )
    # A repeated id with two texts connects their fingerprints.
    twice = hold(
        rows.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
        .where("lo != hi")
        .select("doc_id")
    )
    if not twice.isEmpty():
        ends = (
            rows.join(twice, "doc_id", "left_semi")
            .join(reps, "fp")
            .groupBy("doc_id")
            .agg(F.min("rep").alias("u"), F.collect_set("rep").alias("all"))
        )
        links = links.unionByName(ends.select("u", F.explode("all").alias("v")))
    parts = components(links)
    # As an expression the fingerprint is dealt out anew for the last join; a
    # join of its own two exchanges can split a fingerprint that many rows have.
    named = reps.join(parts, reps["rep"] == parts["node"], "left").select(
        F.col("fp").bitwiseXOR(F.lit(0).cast("bigint")).alias("fp"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that are the least of their component, all columns.

    Rows with a null id stay unless a row with an id has their fingerprint.
    """
    parts = near_components(docs, id_col, text_col, **settings)
    gone = (
        parts.where(F.col("doc_id") != F.col("component_id"))
        .select(F.col("doc_id").alias("__gone"))
        .distinct()
    )
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
