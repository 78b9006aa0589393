"""WARC archives with one Zstandard frame per record and the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

#: First bytes of the skippable frame that holds the dictionary (fixed value of the format).
DICTIONARY_MAGIC = 0x184D2A5D
#: Payload bytes in an archive, bytes of its records the dictionary is trained on, dictionary bytes.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 16 << 20, 2 << 20, 64 << 10
MANIFEST = "name string, records long, bytes long"
RECORDS = "archive string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def digest32(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of its response and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if is_revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and HTTP payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def pack(records: list[bytes], level: int = 3) -> bytes:
    """An archive: the dictionary's skippable frame, then a frame per record."""
    import zstandard as zstd

    sample, size = [], 0
    for r in sorted(records, key=zlib.crc32):  # from all over the archive, alike in each run
        if size >= SAMPLE_BYTES:
            break
        sample.append(r)
        size += len(r)
    try:
        trained = zstd.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), sample, k=256, d=8)
        words = trained.as_bytes()
    except zstd.ZstdError:  # too few or too like records to train on: their first bytes serve as raw content
        words = b"".join(sample)[-DICTIONARY_BYTES:]
    as_dict = zstd.ZstdCompressionDict(words)
    packer = zstd.ZstdCompressor(level=level, dict_data=as_dict, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(words)), words, *[packer.compress(r) for r in records]])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    import zstandard as zstd

    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(archive[8 : 8 + size]))
    at, view = 8 + size, memoryview(archive)
    while at < len(view):
        d = unpacker.decompressobj()
        parts, step = [], 1 << 16
        while not d.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("the last record is cut off")
            parts.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        yield b"".join(parts)


def _named(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, n_bytes and name of every page; pages of one name have one page_id and payload."""
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.length("payload").cast("long"))
    return p.withColumn("name", F.concat_ws(":", "digest", "n_bytes", "page_id"))


def plan_records(pages: DataFrame, least_bytes: int = 0, parts: int | None = None) -> DataFrame:
    """Add digest, keeper: of equal payloads of at least least_bytes, the page with the smallest page_id.

    keeper is null where the payload is its own response. Pages that tie for the smallest
    page_id are all responses; pages without page_id are the keepers of nothing. Payloads move
    once, to parts partitions by name; who refers to whom is found from digests alone.
    """
    slim = _named(pages).where(F.col("n_bytes") >= least_bytes).select("page_id", "digest", "n_bytes", "name")
    many = slim.groupBy("digest", "n_bytes").agg(F.min("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null").drop("n")
    repeats = slim.distinct().join(many, ["digest", "n_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("name", "keeper")
    p = _named(pages)
    if parts:  # numbered before the join, so that it takes the partitions as they are
        p = p.repartition(parts, "name").withColumn("part", F.spark_partition_id())
    return p.join(repeats, "name", "left")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, level: int = 3) -> None:
    """Write a record per page into folder (any URI pyarrow's file systems know), *.warc.zst.

    Pages go to partitions by page_id and payload and are sorted there, so a task that runs again
    writes the same archives under the same names; each is written under another name and then
    renamed. Null html is an empty payload; other columns are ignored; an empty table writes none.
    """
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    rows = plan_records(pages, least_bytes, max(1, math.ceil(total / archive_bytes))).sortWithinPartitions("name", "url").select("page_id", "url", "payload", "keeper", "part")

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held, size, count, part = [], 0, 0, None

        def flush():
            nonlocal held, size, count
            name, data = f"pages-{part:06d}-{count:04d}.warc.zst", pack(held, level)
            spare = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(spare) as out:
                out.write(data)
            store.move(spare, f"{root}/{name}")
            made = {"name": [name], "records": [len(held)], "bytes": [len(data)]}
            held, size, count = [], 0, count + 1
            return made

        for batch in batches:
            for page_id, url, payload, keeper, at in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                part = at
                held.append(build_record(page_id, url, payload, digest32(payload), keeper, keeper is not None, date))
                size += len(payload)
                if size >= archive_bytes:
                    yield pa_batch(flush())
        if held:
            yield pa_batch(flush())

    rows.mapInArrow(write, MANIFEST).agg(F.sum("records")).collect()


def pa_batch(columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict(columns)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row per record: archive, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Length and digest of a response are taken from its payload, which must match its header. Archives without records, and a folder without archives,
    give no rows.
    """

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out: dict = {k.split()[0]: [] for k in RECORDS.split(", ")}
                for raw in unpack(content.as_py()):
                    h, payload = parse_record(raw)
                    revisit = h["WARC-Type"] == "revisit"
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if not revisit and (digest32(payload) != digest or len(payload) != size):
                        raise ValueError(f"damaged record in {path}")
                    refers = h.get("X-Refers-To-Page-ID", "")
                    row = (path.rsplit("/", 1)[-1], int(h["X-Page-ID"]) if h["X-Page-ID"] else None, h["WARC-Target-URI"], size, digest, h["WARC-Type"], int(refers) if refers else None, payload.decode() if with_payload and not revisit else None)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(parse, RECORDS)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages' archives to folder (by default a new one in the shared folder) and read them back."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    write_archives(pages, folder)
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)):
        return spark.createDataFrame([], RECORDS)
    return read_archives(spark, folder, with_payload=False)
