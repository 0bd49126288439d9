"""WARC archives, compressed record by record with a Zstandard dictionary.

Each task writes one archive: it trains a dictionary on its first records,
puts it into a leading skippable frame, and compresses every record as a frame
of its own, so any record can be read alone.  Readers need the archive only.

Of records with equal payloads the one with the least id is stored; the others
become revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, shared_dir, small_batches
from .exact_dedup import COUNTERS, HEAVY_SHARE, heavy_hitters

#: Of the format: magic number of the skippable frame that holds the
#: dictionary, and of a Zstandard frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: Bytes of a dictionary, of records that it is trained on, and of a read.
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
READ_BYTES = 1 << 20
LEVEL = 6

_MANIFEST = "path string, records bigint, bytes bigint"
_RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, payload binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def warc_record(page_id, url, payload: bytes, date: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header but not the payload."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_name(page_id)}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {target}")
    if revisit:
        head.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(4, f"WARC-Refers-To: <{_name(refers_to)}>")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The parts of a record that warc_record() wrote."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    ident = lambda x: None if (s := x[1:-1].rpartition(":")[2]) == "none" else int(s)
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": ident(fields["WARC-Record-ID"]),
        "url": url,
        "record_type": fields["WARC-Type"],
        "refers_to": ident(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": None if fields["WARC-Type"] == "revisit" else payload,
    }


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES):
    """A dictionary of records, or a raw one where there are too few to train."""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), records, k=200, d=8)
    except zstandard.ZstdError:
        raw = b"".join(records)[-size:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(sink, records, level: int = LEVEL, sample_bytes: int = SAMPLE_BYTES) -> tuple[int, int]:
    """Write records (bytes) to a binary sink; gives their number and the size.

    The records are held until sample_bytes are there to train on, then
    streamed.  No record gives an archive with an empty dictionary.
    """
    sample, held, n, size = [], 0, 0, 0
    records = iter(records)
    for r in records:
        sample.append(r)
        held += len(r)
        if held >= sample_bytes:
            break
    # The dictionary compresses poorly by itself and is stored as it is.
    book = train_dictionary(sample) if sample else zstandard.ZstdCompressionDict(b"")
    data = book.as_bytes()
    size += sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
    press = zstandard.ZstdCompressor(level=level, dict_data=book, write_checksum=True) if sample else None
    while sample or (sample := list(_few(records))):
        for r in sample:
            size += sink.write(press.compress(r))
            n += 1
        sample = []
    return n, size


def _few(records, n: int = 64):
    for _, r in zip(range(n), records, strict=False):
        yield r


def read_archive(source):
    """The records of an archive, one at a time, from a binary source."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    data = source.read(n)
    raw = not data.startswith(struct.pack("<I", 0xEC30A437))
    book = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO)
    opener = zstandard.ZstdDecompressor(dict_data=book)
    left = b""
    while True:
        left = left or source.read(READ_BYTES)
        if not left:
            return
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if not left and not (left := source.read(READ_BYTES)):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _open(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, inner


def _uri(path: str) -> str:
    """file:/x as file:///x, which the Arrow file systems want."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _writer(folder: str, date: str, level: int):
    def run(batches):
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.zst"

        def records():
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    page_id, url, html, refers_to, revisit = row
                    yield warc_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), date, refers_to, revisit)

        fs, inner = _open(name)
        with fs.open_output_stream(inner) as sink:
            n, size = write_archive(sink, records(), level)
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return run


def _reader(payloads: bool):
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, inner = _open(path)
                rows, size = [], 0
                with fs.open_input_stream(inner, buffer_size=READ_BYTES) as source:
                    for data in read_archive(source):
                        r = parse_record(data)
                        if r["payload"] is not None and payload_digest(r["payload"]) != r["payload_digest"]:
                            raise ValueError(f"{path}: payload and digest of {r['page_id']} differ")
                        if not payloads:
                            r["payload"] = None
                        rows.append(r)
                        size += len(data)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def revisits(
    pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """(page_id, first_id) of rows whose payload an earlier id has, one row an id.

    Payloads under min_bytes are never revisits.  Equality is that of SHA-256.
    Digests of huge groups are found as in exact dedup and stay out of the
    shuffle.  Rows with null ids are stored as they are.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = hold(
        pages.where(F.col(id_col).isNotNull() & (F.octet_length(payload) >= min_bytes)).select(
            F.col(id_col).alias("page_id"),
            F.unhex(F.sha2(payload, 256)).alias("digest"),
            (-F.col(id_col)).alias("order"),
        )
    )
    # The winner is the largest order, that is the least id.
    heavy = heavy_hitters(rows, "digest", "order", COUNTERS, HEAVY_SHARE)
    split = rows.join(F.broadcast(heavy), "digest", "left")
    hot = split.where("winner IS NOT NULL").select("page_id", (-F.col("winner")).alias("first_id"))
    cold = split.where("winner IS NULL").select("page_id", "digest")
    least = cold.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    cold = cold.join(least.where("n > 1"), "digest").select("page_id", "first_id")
    return hot.unionByName(cold).where("page_id > first_id").distinct()


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    level: int = LEVEL,
) -> DataFrame:
    """Write a record for each row of pages; gives (path, records, bytes) by archive.

    Line breaks of urls are percent-encoded.
    The list holds the archives of tasks that succeeded; a retried task writes
    another file, and the one that failed is not listed.  Null payloads are
    empty, null urls have no target.  folder must be one that all executors
    reach through an Arrow file system.  A row that repeats an id with another
    payload is judged by that payload's first id only if the id itself differs.
    """
    small_batches(pages.sparkSession, 256)
    again = revisits(pages, id_col, payload_col, min_bytes)
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html")
    )
    # Rows without an id have no part in the join, which would deal them all to one task.
    judged = rows.where("page_id IS NOT NULL").join(again, "page_id", "left")
    judged = judged.unionByName(rows.where("page_id IS NULL").withColumn("first_id", F.lit(None).cast("bigint")))
    rows = judged.select("page_id", "url", "html", F.col("first_id").alias("refers_to"), F.col("first_id").isNotNull().alias("revisit"))
    fs, inner = _open(folder)
    fs.create_dir(inner, recursive=True)
    # A row a task, like a listing of the files.
    done = rows.mapInArrow(_writer(folder, date, level), _MANIFEST)
    return pages.sparkSession.createDataFrame(done.collect(), done.schema)


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that write_warc() listed."""
    # An archive is one task's work to read, as it was to write.
    paths = archives.select("path").repartition("path")
    return paths.mapInArrow(_reader(payloads), _RECORDS)


def archive_folder(spark: SparkSession) -> str:
    return f"{_uri(shared_dir(spark))}/skein-warc-{uuid.uuid4().hex}"


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_warc(pages, archive_folder(spark))
    return read_warc(archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
q AS (SELECT page_id, x, unnest(range(32)) AS k FROM p),
-- Digit k of base 32 is bits 5k to 5k+4; two hex digits from digit 5k div 4 hold them.
d AS (SELECT page_id, k, (('0x' || substr(x || '0', (5 * k) // 4 + 1, 2))::INTEGER >> (3 - (5 * k) % 4)) & 31 AS v FROM q),
b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY k) AS payload_digest FROM d GROUP BY page_id)
SELECT p.page_id, strlen(p.h) AS payload_bytes, b.payload_digest,
  CASE WHEN p.page_id = m.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> m.first_id THEN m.first_id END AS refers_to
FROM p JOIN m ON p.h = m.h JOIN b ON p.page_id = b.page_id
"""
