"""WARC archives: writing captures, reading records back, assembling transactions."""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.common import bounded, cut_lineage

_EOL = "\r\n"
FILE_RECORDS = 3000
LARGE_BYTES = 64 << 10
BROADCAST_OWNERS = 100_000
SALTS = 64
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: RFC 4648


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits; ten of them make eight."""
    part = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*part), _DIGITS, _BASE32)


def _headers(kind: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit("WARC/1.1" + _EOL + "WARC-Type: "), kind, F.lit(_EOL))]
    lines += [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(_EOL)), F.lit("")) for k, v in fields]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_EOL + _EOL), block)


def _urn(seed: Column, role: str) -> Column:
    h = F.md5(F.concat(F.lit(role + "/"), seed))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def captures(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(id, url, html, digest, owner struct<id, url>) of each page; owner is null for responses.

    Of the captures whose payloads are equal and have at least ``least_bytes`` bytes, that with the
    largest id (and url) is a response and those with smaller ids are revisits of it.  Only ids, urls
    and digests are grouped.  Up to BROADCAST_OWNERS repeated digests are broadcast; more are joined,
    with SALTS copies of each, so that a hot digest spreads.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", base32_of_hex(F.sha1("html")))
    known = rows.where((F.octet_length("html") >= least_bytes) & F.col("id").isNotNull())
    owners = known.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("owner"), F.min("id").alias("least"))
    owners = cut_lineage(owners.where("owner.id <> least").select("digest", "owner"))
    if owners.count() <= BROADCAST_OWNERS:
        rows = rows.join(F.broadcast(owners), "digest", "left")
    else:
        dealt = owners.select("digest", "owner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = rows.withColumn("salt", F.pmod(F.hash("id", "url"), F.lit(SALTS))).join(dealt, ["digest", "salt"], "left")
    return rows.withColumn("owner", F.when(F.col("id") < F.col("owner.id"), F.col("owner")))


def _record_id(digest: Column, id_: Column, url: Column, role: str) -> Column:
    """A name that follows from the page, so a task that runs again writes it again; only rows equal in
    id, url and payload share one."""
    return _urn(F.concat_ws("/", digest, F.coalesce(id_.cast("string"), F.lit("-")), F.coalesce(url, F.lit(""))), role)


def records(rows: DataFrame) -> DataFrame:
    """One row (record string) for each WARC record of :func:`captures`: request, response or revisit, and metadata."""
    revisit = F.col("owner").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    target = ("WARC-Target-URI", F.nullif(uri, F.lit("")))
    date = ("WARC-Date", F.lit("2020-01-01T00:00:00Z"))
    name = lambda role: _record_id(F.col("digest"), F.col("id"), F.col("url"), role)
    host = F.regexp_extract(uri, r"://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{_EOL}Host: "), host, F.lit(_EOL + _EOL))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.octet_length("html").cast("string"), F.lit(_EOL + _EOL))
    facts = F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(_EOL)), F.lit(""))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    profile = ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers = ("WARC-Refers-To", F.when(revisit, _record_id(F.col("digest"), F.col("owner.id"), F.col("owner.url"), "response")))
    http, fields = "application/http; msgtype=", "application/warc-fields"
    concurrent = ("WARC-Concurrent-To", name("response"))
    response = _headers(F.when(revisit, "revisit").otherwise("response"), [("WARC-Record-ID", name("response")), target, date, digest, profile, refers, ("Content-Type", F.lit(http + "response"))], F.when(revisit, head).otherwise(F.concat(head, "html")))
    request = _headers(F.lit("request"), [("WARC-Record-ID", name("request")), concurrent, target, date, ("Content-Type", F.lit(http + "request"))], get)
    metadata = _headers(F.lit("metadata"), [("WARC-Record-ID", name("metadata")), concurrent, target, date, ("Content-Type", F.lit(fields))], facts)
    return rows.select(F.explode(F.array(request, response, metadata)).alias("record"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Writes gzipped WARC files; the text writer's line separator is the blank lines that end a record.

    A file holds at most FILE_RECORDS records of payloads up to LARGE_BYTES, or one larger capture, so
    its bytes are bounded too.
    """
    rows = captures(pages, id_col, url_col, html_col, least_bytes)
    large = F.octet_length("html") > LARGE_BYTES
    for part, most, mode in ((~large, FILE_RECORDS, "overwrite"), (large, 3, "append")):
        records(rows.where(part)).write.mode(mode).option("lineSep", 2 * _EOL).option("maxRecordsPerFile", most).option("compression", "gzip").text(folder)


_TYPES = "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, payload_digest string, content_type string, head string, block binary"


def parse(stream: BinaryIO) -> Iterator[dict]:
    """Records of an open WARC file, cut by Content-Length; what stands between records is skipped.

    An HTTP block comes as its head (whatever its length) and the bytes after it.
    """
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        kind, head, block = fields.get("content-type", ""), None, stream.read(int(fields.get("content-length", 0)))
        if kind.startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
            head = head.decode("utf-8", "replace")
        yield {
            "type": fields.get("warc-type"),
            "record_id": fields.get("warc-record-id"),
            "concurrent_to": fields.get("warc-concurrent-to"),
            "refers_to": fields.get("warc-refers-to"),
            "uri": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"),
            "payload_digest": fields.get("warc-payload-digest"),
            "content_type": kind or None,
            "head": head,
            "block": block,
        }


def _opened(raw: bytes) -> BinaryIO:
    """The archive in ``raw``, gzipped (in one or many members) or not."""
    return gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw.startswith(b"\x1f\x8b") else io.BytesIO(raw)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the WARC files in a folder, gzipped or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(n, pa.binary() if n == "block" else pa.string()) for n in (x.split()[0] for x in _TYPES.split(", "))])
        for batch in bounded(batches):  # a row is a whole file
            for k in range(batch.num_rows):
                held, size = [], 0
                for record in parse(_opened(batch.column(0)[k].as_py())):
                    held.append(record)
                    size += len(record["block"])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, shape)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, shape)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(run, _TYPES)


def measured(found: DataFrame) -> DataFrame:
    """Records with what is asked of their blocks: length and digest of a payload that was read, the
    text of metadata; ``payload`` itself can be dropped before records are joined."""
    main = F.col("type").isin("response", "revisit")
    return found.select(
        "type", "record_id", "concurrent_to", "refers_to", "uri", "date", "head", F.substring_index("payload_digest", ":", -1).alias("said"),
        F.when(main, F.octet_length("block").cast("long")).alias("payload_bytes"), F.when(F.col("type") == "response", base32_of_hex(F.sha1("block"))).alias("read"),
        F.when(F.col("type") == "metadata", F.decode("block", "UTF-8")).alias("facts"), F.when(main, F.col("block")).alias("payload"),
    )


def transactions(found: DataFrame) -> DataFrame:
    """One nested row for each capture among :func:`measured` records: its response or revisit, with the request and metadata that
    name it in WARC-Concurrent-To.

    Columns: record_id, refers_to (of a revisit, the record it repeats), uri, date, record_type,
    http_head, payload, payload_bytes and payload_digest (both of the payload that was read; a
    revisit's digest is its header's), intact (whether that digest is the header's), request (string), metadata (map).  A capture without a request or metadata has null there,
    one with several gets the smallest; request and metadata records that name no capture are left out.
    """
    main = found.where(F.col("type").isin("response", "revisit"))
    main = main.select(
        "record_id", "refers_to", "uri", "date", F.col("type").alias("record_type"), F.col("head").alias("http_head"), "payload", "payload_bytes",
        F.coalesce("read", "said").alias("payload_digest"), F.coalesce(F.col("read") == F.col("said"), F.col("said").isNotNull() & F.col("read").isNull()).alias("intact"),
    )
    asked = found.where("type = 'request'").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min("head").alias("request"))
    facts = found.where("type = 'metadata'").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min("facts").alias("facts"))
    facts = facts.select("record_id", F.str_to_map(F.rtrim("facts", F.lit(_EOL)), F.lit(_EOL), F.lit(": ")).alias("metadata"))
    return main.join(asked, "record_id", "left").join(facts, "record_id", "left")


def resolved(done: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Captures with their page's id, and revisits with bytes, digest and id of the response they name.

    A revisit whose response is missing, or whose own digest differs from that of the payload read
    there, is not intact.  Columns: id_col, payload_bytes, payload_digest, record_type, refers_to,
    intact and, nested, capture.
    """
    page = F.try_element_at("metadata", F.lit("page-id")).cast("long")
    done = done.withColumn("page", page)
    named = done.where("record_type = 'revisit'").select(F.col("refers_to").alias("target")).distinct()  # as few as there are repeated payloads
    held = done.where("record_type = 'response'").select(F.col("record_id").alias("target"), "payload_bytes", "payload_digest", "page", "intact").join(named, "target", "left_semi")
    held = held.groupBy("target").agg(F.min(F.struct("payload_bytes", "payload_digest", "page", "intact")).alias("held"))  # rows repeated in full share a record
    done = done.join(held, done["refers_to"] == held["target"], "left")
    revisit = F.col("record_type") == "revisit"
    intact = F.when(revisit, F.coalesce((F.col("held.payload_digest") == F.col("payload_digest")) & F.col("held.intact"), F.lit(False))).otherwise(F.col("intact"))
    return done.select(
        F.col("page").alias(id_col),
        F.when(revisit, F.col("held.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.coalesce("held.payload_digest", "payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("held.page")).alias("refers_to"),
        intact.alias("intact"),
        F.struct("record_id", "uri", "date", "http_head", "payload", "request", "metadata").alias("capture"),
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", payloads: bool = True) -> DataFrame:
    """Writes the pages as WARC files into the shared folder and assembles them from there again.

    Null html: an empty payload; null and repeated ids: captures of their own (a null id neither
    revisits nor is revisited); rows repeated in full: as many equal captures; very long pages: files
    of their own; an empty table: no rows; other columns are ignored.  Columns: see :func:`resolved`.
    Without ``payloads`` there is no capture column, and the archives are deleted once they are read;
    with it they stay, as rows are read from them on demand.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, id_col, url_col, html_col)
    found = measured(read_archives(spark, folder))
    if payloads:
        return resolved(transactions(found), id_col)
    found = cut_lineage(found.drop("payload")).withColumn("payload", F.lit(None).cast("binary"))
    done = resolved(transactions(found), id_col).drop("capture")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local session without one gets its own."""
    cut_lineage(spark.range(0))
    return spark.sparkContext.getCheckpointDir()
