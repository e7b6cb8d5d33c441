"""WARC archives with Zstandard dictionary compression.

An archive begins with a skippable frame that holds the dictionary; every record is a frame of its own
after it, so a record can be read by its offset. The dictionary is trained on a bounded sample of the
records. Records of equal payloads are stored once: that of the largest page id is a response, others
are revisits that refer to it. Executors write archives as files, one file each, and read them back.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.session import cut, join_counted

#: Fixed values of the published format: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date makes archives reproducible; pages carry none.
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record; a revisit keeps the digest and length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "urn:unknown").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers by lower-case name, HTTP head, payload)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION.decode():
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return headers, http, payload


def train_dictionary(samples: list[bytes], size: int = 1 << 16) -> bytes:
    """A dictionary from sample records. Where they are too few or too alike to train on, the end of them is the
    dictionary as it stands; without any sample there is none."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


class Writer:
    """Compresses records one by one with a dictionary."""

    def __init__(self, dictionary: bytes, level: int = 3):
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True)

    def frame(self, record: bytes) -> bytes:
        return self.compressor.compress(record)


def read_archive(data: bytes) -> Iterator[bytes]:
    """Records of an archive in order; the dictionary comes from its leading frame."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    dictionary = data[8 : 8 + n]
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decompressor, rest = zstandard.ZstdDecompressor(dict_data=known), memoryview(data)[8 + n :]
    while len(rest):
        magic, n = struct.unpack_from("<II", rest) if len(rest) >= 8 else (0, 0)
        if SKIPPABLE_MAGIC <= magic < SKIPPABLE_MAGIC + 16:
            rest = rest[8 + n :]
            continue
        one = decompressor.decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]


ARCHIVES = "archive string, n_records long, content binary"


def _plain(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def sample_records(pages: DataFrame, limit: int = 400, most_bytes: int = 1 << 15) -> list[bytes]:
    """At most ``limit`` records, those of the smallest id hashes, to train on; of a payload longer than
    ``most_bytes`` four pieces of a quarter of that, spread over the whole of it.

    Tasks first drop the hashes that the row count says can't be among them, so that what they send stays bounded.
    """
    plain, piece = _plain(pages), most_bytes // 4
    share = min(1.0, 4.0 * limit / max(1, pages.count()))
    h = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30))
    n = F.length("html")
    spread = F.array(*[F.substring("html", F.lit(1) + F.floor((n - piece) * (k / 3.0)).cast("int"), F.lit(piece)) for k in range(4)])
    pieces = F.when(n <= most_bytes, F.array("html")).otherwise(spread).alias("pieces")
    rows = plain.withColumn("h", h).filter(F.col("h") <= F.lit(int(share * (1 << 30)))).select("h", "page_id", "url", pieces).orderBy("h", "page_id", "url").limit(limit)
    return [x for r in rows.collect() for x in (build_record(r.page_id, r.url, r.pieces[0].encode(), None, False), *(t.encode() for t in r.pieces[1:]))]


def write_archives(pages: DataFrame, *, volume_bytes: int = 16 << 20, dictionary: bytes | None = None) -> DataFrame:
    """Archives of all pages as rows (archive, n_records, content), content being a whole .warc.zst file.

    An archive ends once it holds ``volume_bytes``. ``dictionary``: a trained one, else it is trained
    on ``sample_records``. A null html is an empty payload; a null url an unknown target; null page ids
    are smallest, and rows that repeat the largest page id of their payload are all responses; an
    empty table gives no archives; other columns are not read. Payloads meet by SHA-256: digests are
    counted before they are dealt, and pages of a digest that very many share stay where they are.
    """
    plain = _plain(pages).withColumn("digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    best = cut(plain.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1"))
    joined = join_counted(plain, best, "digest", "n", "page_id", "best").select("page_id", "url", "html", "best")
    known = train_dictionary(sample_records(pages)) if dictionary is None else dictionary
    shared = pages.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, n, writer = TaskContext.get().partitionId(), 0, 0, None
        frames: list[bytes] = []
        held = 0

        def volume() -> pa.RecordBatch:
            content = dictionary_frame(shared.value) + b"".join(frames)
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{seq:05d}.warc.zst"]), pa.array([n], pa.int64()), pa.array([content], pa.binary())], names=["archive", "n_records", "content"])

        for batch in batches:
            writer = writer or Writer(shared.value)
            for page, url, html, top in zip(*(batch.column(i) for i in range(4)), strict=True):
                page, top = page.as_py(), top.as_py()
                revisit = top is not None and page != top
                frames.append(writer.frame(build_record(page, url.as_py(), html.as_py().encode(), top, revisit)))
                held, n = held + len(frames[-1]), n + 1
                if held >= volume_bytes:
                    yield volume()
                    seq, n, held = seq + 1, 0, 0
                    frames.clear()
        if frames:
            yield volume()

    return joined.mapInArrow(run, ARCHIVES)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of archives: ids, types, digests and lengths.

    A response's payload is hashed and measured again and must agree with its headers; a revisit's
    come from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out: list[tuple] = []
                for data in read_archive(batch.column(0)[k].as_py()):
                    headers, http, payload = parse_record(data)
                    digest = headers["warc-payload-digest"].partition(":")[2]
                    size = int(http.decode().rpartition("Content-Length: ")[2])
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and (payload_digest(payload) != digest or len(payload) != size):
                        raise ValueError("a payload differs from its digest")
                    out.append((page_of(headers["warc-record-id"]), size, digest, headers["warc-type"], page_of(headers["warc-refers-to"]) if revisit else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("content").mapInArrow(run, RECORDS)


#: What Spark's text sink ends a row with: an empty skippable frame, which readers of archives pass over.
ROW_END = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")


def save_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file in ``folder``, from the executors, through Spark's file systems.

    Contents go through the text sink, which writes a string's bytes as they are; a file is one row and
    ends with an empty skippable frame. Output is not compressed again, whatever the cluster's setting. An
    empty table gives a folder without archives.
    """
    content = archives.select(F.col("content").cast("string").alias("value"))
    content.write.option("maxRecordsPerFile", 1).option("lineSep", ROW_END).option("compression", "none").text(folder)


def load_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(content) of the archive files in a folder; empty files are left out."""
    return spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")


def export_archives(archives: DataFrame, folder: str) -> list[str]:
    """``save_archives``, after which the files are renamed to *.warc.zst; only names come to the driver."""
    save_archives(archives, folder)
    spark = archives.sparkSession
    jvm, out = spark.sparkContext._jvm, []
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("part-") and status.getLen():
            to = jvm.org.apache.hadoop.fs.Path(path, name.rpartition(".")[0] + ".warc.zst")
            if not fs.rename(status.getPath(), to):
                raise OSError(f"can't rename {name}")
            out.append(str(to))
    return out
