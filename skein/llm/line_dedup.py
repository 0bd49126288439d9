"""Line dedup on built-in functions only.

Line hashes are range-partitioned and sorted by hash, document and position;
a running minimum streams past each hash and marks every line whose key an
earlier document holds.  Decisions come back as one compressed keep bitmap a
document; texts never enter the shuffle of lines.

Keys that many lines have are counted map-side and decided by a broadcast of
their first documents; only the others are range-partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, hold
from .exact_dedup import heavy_from

#: Shorter keys are never dropped.
MIN_CHARS = 10
#: A key is heavy from this share of all long lines on, or from as many lines as
#: heavy_from() says; it bounds the broadcast as well.
HEAVY_SHARE = 1 / 512


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    share: float = HEAVY_SHARE,
) -> DataFrame:
    """(doc_id, text_hash, n_dropped, drops) of documents that lose lines.

    drops is the complement of the keep bitmap in compressed form: sorted
    (word, bits) pairs for the 64-line words in which some line goes; all lines
    of other words stay.  Rows that repeat an id are one document; rows with a
    null id lose no line and hold none for others.
    """
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text_col).alias("text_hash"),
            F.posexplode(F.split(text_col, "\n")).alias("pos", "line"),
        )
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select(
            "doc_id",
            "text_hash",
            "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
        )
    )
    lines = hold(lines)
    least = heavy_from(lines.count(), share)
    heavy = hold(
        lines.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
        .where(F.col("n") >= least)
        .drop("n")
    )
    marked = lines.join(F.broadcast(heavy), ["h1", "h2"], "left")
    common = marked.where("doc_id > first_doc")
    run = (
        Window.partitionBy("h1", "h2")
        .orderBy("doc_id", "pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rest = (
        marked.where("first_doc IS NULL")
        .drop("first_doc")
        .repartitionByRange("h1", "h2")
        .withColumn("first_doc", F.min("doc_id").over(run))
        .where("doc_id > first_doc")
    )
    dropped = common.select("doc_id", "text_hash", "pos").unionByName(rest.select("doc_id", "text_hash", "pos"))
    words = dropped.groupBy("doc_id", "text_hash", F.expr("pos div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Each row of docs with kept_text, n_lines and n_dropped.

    A key (line without outer blanks, A-Z lower-cased) of at least min_chars
    characters that two documents hold stays in the smallest doc_id only.
    Null and empty texts are one empty line.  Columns of docs stay.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, **settings)
    # The sparse words become an array that a line's position indexes.
    dense = F.expr(
        "flatten(transform(drops, (d, i) -> concat("
        "array_repeat(0L, cast(d.word - if(i = 0, -1L, get(drops, i - 1).word) - 1 as int)), array(d.bits))))"
    )
    bitmaps = bitmaps.select(
        F.col("doc_id").alias("__bm_id"),
        F.col("text_hash").alias("__bm_hash"),
        F.col("n_dropped").alias("__bm_n"),
        dense.alias("__bm_words"),
    )
    left = docs.withColumn("__hash", F.xxhash64(text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.expr(
        f"array_join(filter(split(coalesce(`{text_col}`, ''), '\\n'), (line, i) -> "
        "(shiftright(coalesce(get(__bm_words, cast(i div 64 as int)), 0L), i % 64) & 1L) = 0L), '\\n')"
    )
    return (
        left.join(
            bitmaps,
            (left[id_col] == bitmaps["__bm_id"]) & (left["__hash"] == bitmaps["__bm_hash"]),
            "left",
        )
        .withColumn("kept_text", F.when(F.col("__bm_n").isNull(), text).otherwise(kept))
        .withColumn("n_lines", F.size(F.split(text, "\n")).cast("bigint"))
        .withColumn("n_dropped", F.coalesce("__bm_n", F.lit(0)).cast("bigint"))
        .drop("__bm_id", "__bm_hash", "__bm_n", "__bm_words", "__hash")
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP2_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
j AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id > s.first_doc AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
