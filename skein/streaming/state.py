"""State across runs: batch upserts, and the same folds over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.stories import latest


def health_counters(events: DataFrame, domain: str, ok: Column, time: str) -> DataFrame:
    """Per domain: successes, failures, last times of both."""
    good = F.coalesce(ok, F.lit(False))
    return events.groupBy(domain).agg(
        F.count_if(good).alias("successes"),
        F.count_if(~good).alias("failures"),
        F.max(F.when(good, F.col(time))).alias("last_success"),
        F.max(F.when(~good, F.col(time))).alias("last_failure"),
    )


def merge_health(old: DataFrame, new: DataFrame, domain: str) -> DataFrame:
    """Counters of former runs and of this one."""
    return old.unionByName(new).groupBy(domain).agg(
        F.sum("successes").alias("successes"),
        F.sum("failures").alias("failures"),
        F.max("last_success").alias("last_success"),
        F.max("last_failure").alias("last_failure"),
    )


def breaker(runs: DataFrame, key: str, time: str, seq: str, failed: Column, threshold: int = 5) -> DataFrame:
    """(key, consecutive_failures, open, recent): the failure streak at the end of each key's runs.

    recent: the last three failures' seq within the streak, oldest first.
    """
    rows = runs.withColumn("__failed", F.coalesce(failed, F.lit(False)))
    last_ok = rows.where("NOT __failed").groupBy(key).agg(F.max(F.struct(time, seq)).alias("ok"))
    after = rows.join(last_ok, key, "left").where(F.col("__failed") & (F.col("ok").isNull() | (F.struct(time, seq) > F.col("ok"))))
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc(seq))
    ranked = after.withColumn("nth", F.row_number().over(order))
    agg = ranked.groupBy(key).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct(F.col(time), F.col(seq).alias("seq"))))).alias("recent")
    )
    return rows.select(key).distinct().join(agg, key, "left").select(
        key,
        F.coalesce("n", F.lit(0)).alias("consecutive_failures"),
        (F.coalesce("n", F.lit(0)) >= threshold).alias("open"),
        F.coalesce(F.array_join(F.transform("recent", lambda r: r["seq"].cast("string")), ","), F.lit("")).alias("recent"),
    )


def longest_streaks(runs: DataFrame, key: str, time: str, seq: str, failed: Column) -> DataFrame:
    """(key, longest): the longest run of failures, by gaps and islands."""
    rows = runs.withColumn("__failed", F.coalesce(failed, F.lit(False)).cast("int"))
    run = Window.partitionBy(key).orderBy(time, seq).rowsBetween(Window.unboundedPreceding, 0)
    island = rows.withColumn("island", F.sum(1 - F.col("__failed")).over(run)).where("__failed = 1")
    return island.groupBy(key, "island").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def mark_seen(seen: DataFrame, stories: DataFrame, key: str, time: str) -> DataFrame:
    """seen with the stories put in: first and last time of each key."""
    both = seen.select(key, "first_seen", "last_seen").unionByName(
        stories.select(key, F.col(time).alias("first_seen"), F.col(time).alias("last_seen"))
    )
    return both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def record_attempts(failed: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """failed (key, attempt_count, last_attempt) with attempts (key, ok, ts); a success clears."""
    ok_at = attempts.where("ok").groupBy(key).agg(F.max("ts").alias("ok_at"))
    new = attempts.where("NOT ok").select(key, F.lit(1).cast("bigint").alias("attempt_count"), F.col("ts").alias("last_attempt"))
    both = failed.select(key, "attempt_count", "last_attempt").unionByName(new).join(ok_at, key, "left")
    left = both.where(F.col("ok_at").isNull() | (F.col("last_attempt") > F.col("ok_at")))
    return left.groupBy(key).agg(F.sum("attempt_count").alias("attempt_count"), F.max("last_attempt").alias("last_attempt"))


def on_cooldown(failed: DataFrame, key: str, now: Column, hours: float = 24.0, attempts: int = 2) -> DataFrame:
    """Keys with enough attempts, the last of them not long ago."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_attempt").cast("timestamp"))) / 3.6e9
    return failed.where((F.col("attempt_count") >= attempts) & (age < hours)).select(key)


def conditional_headers(feeds: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """feeds with the etag and last_modified of their last full answer, null where there is none.

    log: (key, status, etag, last_modified, fetched); only answers of 200 carry them.
    """
    last = log.where("status = 200").groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct("etag", "last_modified"), "fetched").alias("__h"))
    return feeds.join(last, feeds[key] == last["__k"], "left").select(*[feeds[c] for c in feeds.columns], F.col("__h.etag").alias("etag"), F.col("__h.last_modified").alias("last_modified"))


def run_ledger(calls: DataFrame, run: str) -> DataFrame:
    """(run, calls, writer_families, verifier_family, fallbacks) of each run.

    calls: (run, seq, role, family, error); the last verifier counts, writers are
    listed in order, fallbacks are the errors in order.
    """
    listed = lambda value, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("seq", value.alias("x"))))), lambda r: r["x"])
    return calls.groupBy(run).agg(
        F.count_if(F.col("error").isNull()).alias("calls"),
        listed(F.col("family"), (F.col("role") == "writer") & F.col("error").isNull()).alias("writer_families"),
        F.max_by("family", F.when((F.col("role") == "verifier") & F.col("error").isNull(), F.col("seq"))).alias("verifier_family"),
        listed(F.col("error"), F.col("error").isNotNull()).alias("fallbacks"),
    )


def jitter(delay: Column, ratio: float, chance: Column) -> Column:
    """A delay spread by up to that share to both sides; chance lies in [0, 1)."""
    spread = F.greatest(F.lit(0.0), delay * (1 + ratio * (2 * chance - 1))) if ratio > 0 else delay
    return F.round(spread, 3)


# ---- streams ----------------------------------------------------------------


def windowed_counts(stream: DataFrame, time: str, key: str, delay: str = "7 days", size: str = "1 day") -> DataFrame:
    """Counts of a key per window of event time, late rows dropped; the same plan runs in batch."""
    timed = stream.withColumn("__at", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("__at", delay)
    counts = timed.groupBy(F.window("__at", size), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def run_available(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its result, a table beside the checkpoint.

    A batch that runs again overwrites its own part.  In complete mode the last
    batch is the result.
    """
    spark, parts = stream.sparkSession, []

    def put(batch: DataFrame, number: int) -> None:
        parts.append(f"{checkpoint}-result/batch={number}")
        batch.write.mode("overwrite").parquet(parts[-1])

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not parts:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(parts[-1:] if mode == "complete" else dict.fromkeys(parts)))


def fold_pool(stream: DataFrame, path: str, checkpoint: str, key: list[str], time: str, seq: str):
    """Keep the latest row of each key in a table, batch by batch.

    Batches write numbered versions; a batch that runs again writes its own
    version again, from the one before it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}").unionByName(batch)
        latest(rows, key, time, seq).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _streak(threshold: int) -> Callable:
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(parts).sort_values(["ts", "seq"])
        for failed in rows["failed"]:
            n = n + 1 if failed else 0
        state.update((n,))
        yield pd.DataFrame({"key": [str(key[0])], "consecutive_failures": [n], "open": [n >= threshold]})

    return step


def breaker_stream(stream: DataFrame, threshold: int = 5) -> DataFrame:
    """Streaming breaker over (key, ts, seq, failed): the streak after each batch."""
    return stream.groupBy("key").applyInPandasWithState(
        _streak(threshold), "key string, consecutive_failures long, open boolean", "n long", "update", GroupStateTimeout.NoTimeout
    )
