"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries find digests that may be frequent.  An exact count
verifies them, and the winners' keep rows are broadcast, so that rows of huge
groups are decided where they are read.  All other digests are shuffled.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hold

#: Counters of a Misra-Gries summary at least, the share of all rows that makes a
#: digest heavy, and how many rows do so in any case: a task can hold as many.
#: No more than MOST_HEAVY digests can be heavy, which bounds the broadcast.
COUNTERS = 1024
HEAVY_SHARE = 1 / 256
HEAVY_ROWS = 1 << 20
MOST_HEAVY = 1 << 20


def heavy_from(rows: int, share: float) -> int:
    """How many rows make a key heavy, of so many rows in all."""
    return max(2, min(int(rows * share), HEAVY_ROWS), rows // MOST_HEAVY)


def merge_counters(held: dict, more, counters: int) -> dict:
    """Add (key, count) pairs to a Misra-Gries summary of at most so many keys."""
    for key, n in more:
        held[key] = held.get(key, 0) + n
    if len(held) > counters:
        cut = heapq.nlargest(counters + 1, held.values())[-1]
        held = {k: n - cut for k, n in held.items() if n > cut}
    return held


def _summaries(counters: int):
    def run(batches):
        held: dict = {}
        for batch in batches:
            seen = batch.column(0).value_counts()
            held = merge_counters(
                held, zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True), counters
            )
        yield pa.record_batch(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["key", "n"]
        )

    return run


def heavy_hitters(rows: DataFrame, key: str, value: str, counters: int, share: float) -> DataFrame:
    """(key, winner, group_size) of each key that heavy_from() calls heavy.

    winner is the largest value.  Summaries have a few counters for each key
    that can be heavy, so they never miss one; counting their candidates over
    all rows drops the false ones.
    """
    total = rows.count()
    least = heavy_from(total, share)
    counters = max(counters, 4 * (total // least))
    slack = total / (counters + 1)
    found = (
        rows.select(key)
        .mapInArrow(_summaries(counters), "key binary, n bigint")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= max(1, int(least - slack)))
        .select(F.col("key").alias(key))
    )
    # At most total / least rows, each time.
    return hold(
        rows.join(F.broadcast(found), key)
        .groupBy(key)
        .agg(F.max(value).alias("winner"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= least)
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counters: int = COUNTERS,
    share: float = HEAVY_SHARE,
) -> DataFrame:
    """Decide each row: (doc_id, keep_id, group_size, kept, digest binary).

    Texts are equal when their SHA-256 is; null is the empty text.  The row
    with the largest id stays.  A null id is less than any other.  Of rows that
    repeat the staying id, one stays.  Every row gets a result row; an empty
    table gives none; other columns are not looked at.
    """
    rows = hold(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
        )
    )
    heavy = heavy_hitters(rows, "digest", "doc_id", counters, share)
    split = rows.join(F.broadcast(heavy), "digest", "left")
    hot = split.where(F.col("group_size").isNotNull())
    hot_out = hot.where(~F.col("doc_id").eqNullSafe(F.col("winner"))).withColumn("kept", F.lit(False))
    # Only rows that carry the winning id itself meet here.
    hot_top = hot.where(F.col("doc_id").eqNullSafe(F.col("winner")) & F.col("winner").isNotNull())
    no_ids = hot.where(F.col("winner").isNull())
    one = Window.partitionBy("digest", "doc_id").orderBy("doc_id")
    hot_top = hot_top.withColumn("kept", F.row_number().over(one) == 1)
    no_ids = no_ids.withColumn("kept", F.row_number().over(one) == 1)
    hot_out = hot_out.where(F.col("winner").isNotNull())
    group = Window.partitionBy("digest")
    cold = (
        split.where(F.col("group_size").isNull())
        .select("digest", "doc_id")
        .withColumn("winner", F.max("doc_id").over(group))
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("kept", F.row_number().over(group.orderBy(F.desc_nulls_last("doc_id"))) == 1)
    )
    cols = ["doc_id", F.col("winner").alias("keep_id"), "group_size", "kept", "digest"]
    return hot_out.select(cols).unionByName(hot_top.select(cols)).unionByName(
        no_ids.select(cols)
    ).unionByName(cold.select(cols))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, **settings).where("kept")
    return keep_rows(docs, kept, id_col, text_col)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and digest are in kept; of repeated ones, one."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    kept = kept.select(F.col("doc_id").alias("__keep_id"), F.col("digest").alias("__keep_digest"))
    tagged = docs.withColumn("__digest", digest)
    joined = tagged.join(
        kept,
        tagged[id_col].eqNullSafe(kept["__keep_id"]) & (tagged["__digest"] == kept["__keep_digest"]),
        "left_semi",
    )
    # Rows that repeat an id and its text are rare; only with them is it worth
    # dealing the texts out once more.
    repeats = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__h")).groupBy("__id", "__h")
    if repeats.count().where("count > 1").isEmpty():
        return joined.drop("__digest")
    one = Window.partitionBy(id_col, "__digest").orderBy(id_col)
    return (
        joined.withColumn("__nth", F.row_number().over(one)).where("__nth = 1").drop("__nth", "__digest")
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.t = g.t
"""
