"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact header of each record is stored apart. A join of the two
gives back every original record, and each payload is hashed anew when it is read.

`write` makes a record for each page: of the records whose payloads are equal and at least `least` bytes long, those of
the smallest page_id are responses and the others revisits of it; shorter payloads are all responses.

Scale: equal payloads meet in a partial aggregation before the shuffle, so a payload that a third of all pages have
travels once for each task; headers are narrow; the join by digest has one payload row for each digest, and Spark splits
the headers' side of a hot one.

Defined cases: a null payload is empty; a null url leaves WARC-Target-URI out; line ends in a url are percent-encoded;
rows that repeat a page_id with an equal payload are all responses if that page_id is the smallest; rows with a null
page_id are never referred to and are revisits if a row with a page_id has their payload; clashing names: only the named
columns are read; a very long payload is one value of one row, 2 GB at most; an empty table makes an empty archive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lodestrata.llm import common

LEAST = 100
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """headers: page_id, digest, warc_header, http_header; payloads: digest, n_bytes, holder (page_id, url), payload."""

    headers: DataFrame
    payloads: DataFrame


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    """A header line, or nothing for null."""
    v = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.coalesce(F.concat(F.lit(f"{name}: "), v, F.lit(CRLF)), F.lit(""))


def write(pages: DataFrame, least: int = LEAST, key: str = "page_id", url: str = "url", payload: str = "html") -> Archive:
    data = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), data.alias("payload"))
    hashed = rows.withColumn("digest", F.sha2("payload", 256))
    holder = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("holder")
    blobs = hashed.groupBy("digest").agg(F.first("payload").alias("payload"), holder)
    payloads = common.stored(blobs.select("digest", F.octet_length("payload").cast("long").alias("n_bytes"), "holder", "payload"), "warc-payloads")
    records = hashed.select("page_id", "url", "digest").join(payloads.select("digest", "n_bytes", "holder"), "digest")
    revisit = (F.col("n_bytes") >= least) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder.page_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise("response")),
        _line("WARC-Record-ID", _uuid(F.col("page_id"), F.col("url"))),
        _line("WARC-Date", DATE),
        _line("WARC-Target-URI", _target("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                _line("WARC-Refers-To", _uuid(F.col("holder.page_id"), F.col("holder.url"))),
                _line("WARC-Refers-To-Target-URI", _target("holder.url")),
                _line("WARC-Refers-To-Date", DATE),
                _line("X-Refers-To-Page-ID", F.col("holder.page_id")),
            ),
        ).otherwise(""),
        _line("X-Page-ID", F.col("page_id")),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", F.octet_length("http_header") + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))),
        F.lit(CRLF),
    )
    headers = records.withColumn("http_header", http).withColumn("warc_header", head).select("page_id", "digest", "warc_header", "http_header")
    return Archive(common.stored(headers, "warc-headers"), payloads)


def _target(url: str) -> Column:
    """A url without the line ends that would end its header line."""
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def field(name: str, header: str = "warc_header") -> Column:
    """A header field's value, or null."""
    v = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(F.col(header), F.lit(f"\r\n{name}: ")), v)


def read(archive: Archive) -> DataFrame:
    """page_id, warc_header, http_header, the full payload (of revisits too) and record, the bytes as first written.

    A payload that does not hash to its digest, or a header without its payload, is an error."""
    joined = archive.headers.join(archive.payloads.select("digest", F.col("payload").alias("_p")), "digest", "left")
    sound = F.sha2("_p", 256).eqNullSafe(F.col("digest"))
    payload = F.when(sound, F.col("_p")).otherwise(F.raise_error(F.concat(F.lit("payload does not match sha256:"), F.col("digest"))).cast("binary"))
    out = joined.withColumn("payload", payload)
    body = F.when(field("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    record = F.concat(F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"), body, F.lit(CRLF + CRLF).cast("binary"))
    return out.select("page_id", "digest", "warc_header", "http_header", "payload", record.alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """records (record: a WARC record's bytes) with what stands in them: warc_header, http_header and body, the HTTP body."""
    end = F.lit(CRLF + CRLF)
    head = F.concat(F.substring_index(F.col("record").cast("string"), CRLF + CRLF, 1), end)
    out = records.withColumn("warc_header", head)
    block = F.substring("record", F.octet_length("warc_header") + 1, field("Content-Length").cast("int"))
    out = out.withColumn("_block", block)
    out = out.withColumn("http_header", F.concat(F.substring_index(F.col("_block").cast("string"), CRLF + CRLF, 1), end))
    return out.withColumn("body", F.substring("_block", F.octet_length("http_header") + 1, F.octet_length("_block"))).drop("_block")


class _Writer(DataSourceWriter):
    def __init__(self, path: str, gzipped: bool):
        self.path, self.gzipped = path, gzipped

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import gzip
        import uuid

        fs, top = FileSystem.from_uri(self.path)
        fs.create_dir(top)
        name = f"{top}/.part-{uuid.uuid4().hex}.warc{'.gz' if self.gzipped else ''}"
        n = 0
        with fs.open_output_stream(name, compression=None) as f:
            for n, (record,) in enumerate(rows, 1):
                f.write(gzip.compress(record, 6, mtime=0) if self.gzipped else record)
        if not n:
            fs.delete_file(name)
        return _Written(name if n else "")

    def commit(self, messages: list) -> None:
        """Files of the attempts that count get their names; those of others stay hidden and are never read."""
        fs, _ = FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(m.name, m.name.replace("/.part-", "/part-"))

    def abort(self, messages: list) -> None:
        fs, _ = FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(m.name)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class WarcFiles(DataSource):
    """`df.write.format("warc_files").mode("append").save(path)` for one binary column: WARC files, a gzip member a record."""

    @classmethod
    def name(cls) -> str:
        return "warc_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(_uri(self.options["path"]), self.options.get("compression", "gzip") == "gzip")


def _uri(path: str) -> str:
    """A path as Spark has it, as pyarrow reads it."""
    if path.startswith("file:"):
        return "file:///" + path[5:].lstrip("/")
    return path if "://" in path else "file://" + path


def export(archive: Archive, path: str, compression: str = "gzip") -> None:
    """The records as WARC files, each a gzip member by itself (compression="none": plain). path: a folder that all share."""
    spark = archive.headers.sparkSession
    common.ship(spark)
    spark.dataSource.register(WarcFiles)
    read(archive).select("record").write.format("warc_files").option("compression", compression).mode("append").save(path)


def _inflated(f) -> Iterator[bytes]:
    """A stream's bytes, of all its gzip members in turn if it is gzip."""
    import zlib

    chunk = f.read(1 << 20)
    if chunk[:2] != b"\x1f\x8b":
        while chunk:
            yield chunk
            chunk = f.read(1 << 20)
        return
    d = zlib.decompressobj(31)
    while chunk:
        while chunk:
            yield d.decompress(chunk, 1 << 22)
            chunk = d.unconsumed_tail
            if d.eof:
                chunk, d = d.unused_data, zlib.decompressobj(31)
        chunk = f.read(1 << 20)


def parse(data: bytes | Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC file, plain or gzip; one record is held at a time."""
    import io

    chunks = _inflated(io.BytesIO(data)) if isinstance(data, bytes) else data
    held = bytearray()

    def fill(enough) -> bool:
        while not enough():
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while fill(lambda: b"\r\n\r\n" in held):
        end = held.index(b"\r\n\r\n") + 4
        header = bytes(held[:end])
        size = next(int(line.split(b":", 1)[1]) for line in header.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        if not fill(lambda stop=end + size: len(held) >= stop):
            raise ValueError("a WARC record is cut off")
        block = bytes(held[end : end + size])
        fill(lambda stop=end + size + 4: len(held) >= stop)
        del held[: end + size + 4]
        yield header, block


def load(spark: SparkSession, path: str) -> DataFrame:
    """warc_header and block of every record of the WARC files under path. A file is one task's work, streamed: one record
    is in memory at a time. Bytes of a header that are not UTF-8 are read as Latin-1."""
    common.ship(spark)

    def shown(header: bytes) -> str:
        try:
            return header.decode()
        except UnicodeDecodeError:
            return header.decode("latin-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestrata.llm import warc

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, place = FileSystem.from_uri(warc._uri(name))
                with fs.open_input_stream(place, compression=None) as f:
                    for header, block in warc.parse(warc._inflated(f)):
                        yield pa.RecordBatch.from_arrays([pa.array([shown(header)]), pa.array([block], pa.binary())], names=["warc_header", "block"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "warc_header string, block binary")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value is read from the bytes of the reconstructed records; of a revisit, whose record has no payload, the
    length is that of the payload which the archive joins to it."""
    back = read(write(common.table(spark, sf_dir, "pages"))).select("record", "payload")
    seen = parsed(back)
    revisit = field("WARC-Type") == "revisit"
    return seen.select(
        field("X-Page-ID").cast("long").alias("page_id"),
        F.octet_length(F.when(revisit, F.col("payload")).otherwise(F.col("body"))).cast("long").alias("payload_bytes"),
        F.when(revisit, F.substring_index(field("WARC-Payload-Digest"), ":", -1)).otherwise(F.sha2("body", 256)).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> holder THEN holder END AS refers_to
FROM f
"""
