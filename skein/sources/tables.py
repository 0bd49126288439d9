"""Readers and writers: tables, JSON state, Markdown articles, feeds."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_state(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON state table; empty where there is none, null fields where a line is broken."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str, run_ts: str) -> None:
    """A run's candidate or health rows, beside those of other runs."""
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").parquet(path)


def route(df: DataFrame, ok: Column, articles: str, drafts: str) -> None:
    """Publish rows that pass, keep the others as drafts; df is computed once."""
    held = df.withColumn("__ok", F.coalesce(ok, F.lit(False))).persist(StorageLevel.DISK_ONLY)
    held.where("__ok").drop("__ok").write.mode("append").parquet(articles)
    held.where("NOT __ok").drop("__ok").write.mode("append").parquet(drafts)
    held.unpersist()


ITEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("pubDate", T.StringType()),
    ]
)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: a row each, with the file it came from."""
    return (
        spark.read.format("xml")
        .option("rowTag", "item")
        .option("ignoreNamespace", "true")
        .schema(ITEM)
        .load(path)
        .withColumn("feed_file", F.input_file_name())
        .withColumn("published", feed_time(F.col("pubDate")))
    )


def feed_time(value: Column) -> Column:
    """RFC 822 or ISO times of feeds; null for anything else."""
    plain = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*", "")
    plain = F.regexp_replace(plain, r"\s(?:GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.regexp_replace(F.trim(value), "Z$", "+00:00")),
    )


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files: path, front matter and body."""
    from skein.functions.text import front_matter

    head, body = front_matter(F.col("value"))
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), head.alias("front"), body.alias("body")
    )


def front_value(front: Column, key: str) -> Column:
    """A scalar of simple front matter, unquoted; null if the key is absent."""
    got = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(got, r"^[\"'](.*)[\"']$", "$1"), F.lit(""))


def render_article(title: Column, description: Column, category: Column, tags: Column, body: Column) -> Column:
    """Markdown with front matter that front_value() reads back."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), r'["\r\n]+', " "), F.lit('"'))
    rows = [
        F.lit("---"),
        F.concat(F.lit("title: "), quote(title)),
        F.concat(F.lit("description: "), quote(description)),
        F.concat(F.lit("category: "), quote(category)),
        F.concat(F.lit("tags: ["), F.array_join(F.transform(tags, quote), ", "), F.lit("]")),
        F.lit("---"),
        body,
    ]
    return F.array_join(F.array(*rows), "\n")


def classify_response(status: Column, content_type: Column, body: Column, items: Column) -> Column:
    """What a feed response is; items: how many entries it has, null if it is no XML."""
    text = F.lower(F.substring(F.ltrim(body), 1, 256))
    html = F.lower(content_type).contains("html") | text.startswith("<!doctype html") | text.contains("<html")
    return (
        F.when(status.isin(403, 429, 503), "blocked")
        .when(status == 304, "not-modified")
        .when((status < 200) | (status >= 300), "http-error")
        .when(F.coalesce(html, F.lit(False)), "blocked")
        .when(F.coalesce(F.length(body), F.lit(0)) == 0, "empty")
        .when(items.isNull(), "invalid-xml")
        .when(items == 0, "empty")
        .otherwise("ok")
    )


def fingerprint(*parts: Column) -> Column:
    """Digest of all inputs of a stage; equal digests allow its result to be reused."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def source_problems(sources: DataFrame) -> DataFrame:
    """(name, problem) for every configured source that breaks a rule, all at once."""
    tests = [
        ("missing name", F.coalesce(F.trim("name"), F.lit("")) == ""),
        ("missing feed_url", F.coalesce(F.trim("feed_url"), F.lit("")) == ""),
        ("bad tier", ~F.coalesce(F.col("tier").isin(1, 2, 3), F.lit(False))),
        ("bad topic", ~F.coalesce(F.col("topic").isin("gaming", "mixed"), F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in tests]))
    return sources.select("name", F.explode(found).alias("problem"))
