"""What several corpus operators share: shared-folder tables, samples, folds."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a small table: so many, or more if each would get more rows.
FILES, ROWS_A_FILE = 6, 1_000_000

#: The white space of the contracts: space, tab, newline, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[str] = []
_held: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir.  Where that is unset, a local master gets a
    temporary folder; a cluster gets an error, as its machines share none.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks that read
    the table, and what follows never computes df twice.  files: for small
    tables, how many files at most.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    _written.append(path)
    give_back_in_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Keep df on the executors' disks for a second reading.

    What a lost executor held is computed again, from a lineage that is short:
    df is made from tables.  Files in the shared folder would cost a process
    each on file systems whose permissions are set by a command.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    _held.append(df)
    return df


def settle_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """settle() in as few files as the rows need, and how many rows there are.

    df is computed by all its tasks; only writing is left to a few.
    """
    held = hold(df)
    n = held.count()
    kept = settle(held, name, max(FILES, n // ROWS_A_FILE))
    let_go(held)
    return kept, n


def let_go(df: DataFrame) -> None:
    """Drop what hold() keeps of df; shuffles behind it can then be cleaned up."""
    df.unpersist()
    _held[:] = [d for d in _held if d is not df]


def kept_now() -> tuple[int, int]:
    """How much hold() and settle() keep, for release()."""
    return len(_held), len(_written)


def release(spark: SparkSession, since: tuple[int, int] = (0, 0), but: DataFrame | None = None) -> None:
    """Drop what hold() keeps and the tables that settle() wrote since then, but that of `but`.

    Readers must be done.
    """
    for df in _held[since[0] :]:
        df.unpersist()
    del _held[since[0] :]
    stays = but.inputFiles() if but is not None else []
    jvm = spark.sparkContext._jvm
    for where in _written[since[1] :]:
        if not any(where.rpartition("/")[2] in f for f in stays):
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _written.remove(where)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold Arrow batches to so many rows, as whole texts can be long.

    Plans read this setting when they run, so it stays for the session.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  lower() does that for ASCII texts."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def sampled(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, max_bytes: int) -> DataFrame:
    """(id, text) of at most n of rows (id first), in the order of a hash of the id.

    Ids and lengths are chosen first, so that texts travel for chosen rows
    only.  Texts stay whole; one that does not fit into max_bytes is passed over,
    and texts over an eighth of that come after all others, so that a few long
    ones leave room.  If no text fits, the first is taken.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("__id"), F.octet_length(F.coalesce(text_col, F.lit(""))).alias("__size")
    )
    ids = rows.select(F.col(rows.columns[0]).alias("__id")).distinct()
    picked = (
        sized.join(ids, "__id")
        .dropDuplicates(["__id"])
        .orderBy(F.col("__size") > max_bytes // 8, F.xxhash64("__id"), "__id")
        .limit(n)
        .collect()
    )
    total, taken = 0, []
    for r in picked:
        if total + r["__size"] <= max_bytes:
            total += r["__size"]
            taken.append(r)
    taken = taken or picked[:1]
    few = spark.createDataFrame([(r["__id"],) for r in taken], "__id bigint")
    return (
        docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"))
        .join(F.broadcast(few), "__id")
        .groupBy(F.col("__id").cast("bigint").alias("id"))
        .agg(F.min("__text").alias("text"))
    )


def bounded_sample(
    rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, max_bytes: int
) -> list[tuple]:
    """The rows of sampled(), brought to the driver."""
    return sorted(map(tuple, sampled(rows, docs, id_col, text_col, n, max_bytes).toLocalIterator()))


_caches: list[dict] = []


def worker_cache() -> dict:
    """A cache that an operator keeps in worker processes, until make_room()."""
    _caches.append({})
    return _caches[-1]


def make_room() -> None:
    """Drop what other operators keep in this worker process, and return the memory."""
    for cache in _caches:
        cache.clear()
    give_back()


def give_back() -> None:
    """Return memory that a worker process has freed, where the C library can; workers live on."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def give_back_in_driver(spark: SparkSession) -> bool:
    """give_back() for the driver's JVM; whether it could, as only some JVMs can (Linux, 17.0.9 and later).

    Planning and compiling in hundreds of threads leave freed native memory in
    as many arenas of the C library, which keeps it otherwise.
    """
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        # By the interface, as the server's own class is not exported.
        methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
        invoke = next(m for m in methods if m.getName() == "invoke")
        args = new_array(jvm.java.lang.Object, 4)
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def fit_in_a_task(rows: DataFrame, fit) -> bytes:
    """fit(list of rows as tuples) as pickled bytes; it runs in one task, so rows must be bounded."""

    def run(batches):
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        model = pickle.dumps(fit(held), pickle.HIGHEST_PROTOCOL)
        del held
        give_back()
        yield pa.record_batch([pa.array([model], pa.binary())], ["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").first()
    give_back_in_driver(rows.sparkSession)
    return bytes(got[0]) if got else pickle.dumps(fit([]))
