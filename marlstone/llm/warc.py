"""WARC archives: writing pages as request, response or revisit, and metadata records; reading archives back; assembling captures.

Archives are written by Spark's text writer with the record terminator as line separator, so they go to any file system that Spark
writes to, under its commit protocol. They are read as binary files, in tasks that hold one archive at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
#: Archives are read whole: they hold at most so many records of pages of at most SMALL bytes (128 MB in all), or one larger page with its own.
RECORDS_PER_FILE, SMALL = 1536, 1 << 18
_NL = "\r\n"


def base32_sha1(text: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string or binary column."""
    code = F.sha1(text)
    letters = []
    for i in range(8):
        five = F.conv(F.substring(code, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(five, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*letters)


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), key))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v) for k, v in headers), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_NL, *lines), F.lit(2 * _NL), block)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, response_id) of the payloads of at least min_bytes that several pages have: their response is the largest page_id."""
    body = F.coalesce("html", F.lit(""))
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(body).alias("digest"), F.octet_length(body).alias("bytes"))
    return each.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "response_id")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Writes for each row (page_id, url, html) a request, a response or revisit, and a metadata record, in gzip archives under path.

    The payload is the html in UTF-8; a null html is an empty payload, a null url an empty address. Control characters of a url are
    percent-encoded. Rows that repeat a page_id and payload share their record ids and are one capture when read. A null page_id is
    written as an empty field and read back as null. Extra columns are ignored. An empty table gives no records.
    """
    twice = small(written(revisits(pages, min_bytes), "revisits"))
    is_small = F.coalesce(F.octet_length("html"), F.lit(0)) <= SMALL
    for some, most in ((is_small, RECORDS_PER_FILE), (~is_small, 3)):
        _records_of(pages.where(some), twice, date).write.mode("append").option("lineSep", 2 * _NL).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _records_of(pages: DataFrame, twice: DataFrame, date: str) -> DataFrame:
    """The records of pages, one a row, without their ends. twice: (digest, response_id) of payloads that several pages have."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", base32_sha1(F.col("html"))).join(twice, "digest", "left")
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    own = F.concat_ws("|", number, "digest")
    uri = F.col("url")
    for c in [*range(33), 127]:
        uri = F.replace(uri, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    again = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    record_id, response_id = _urn("response|", own), _urn("response|", F.concat_ws("|", F.col("response_id").cast("string"), "digest"))
    when, sha = F.lit(date), F.concat(F.lit("sha1:"), "digest")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(2 * _NL))
    http = F.lit("application/http; msgtype=response")
    response = _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", record_id), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", sha), ("Content-Type", http)], F.concat(head, "html"))
    revisit = _record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", record_id), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", sha), ("WARC-Refers-To", response_id)]
        + [("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", http)],
        head,
    )
    host = F.regexp_extract(uri, r"://([^/?#]*)", 1)
    target = F.regexp_extract(uri, r"://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(2 * _NL))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("request|", own)), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", record_id), ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    facts = F.concat(F.lit("page-id: "), number, F.lit(_NL))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata|", own)), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", record_id), ("Content-Type", F.lit("application/warc-fields"))], facts)
    return page.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))


RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "date", "header_digest")]
    + [T.StructField("fields", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType())]
)
_HEADERS = ("WARC-Record-ID", "WARC-Type", "WARC-Concurrent-To", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest")


def parse_archive(content: bytes):
    """Yields (headers, block) of each record of an archive: plain, gzip in one member, or gzip in one member a record."""
    if content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(rest) + d.flush())
            rest = d.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines if ": " in line)
        to = end + 4 + int(headers["Content-Length"])
        yield headers, content[end + 4 : to]
        at = to + 4


def _records(with_payload: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for headers, block in parse_archive(batch.column(0)[i].as_py()):
                    kind = headers.get("WARC-Type")
                    payload = block.split(b"\r\n\r\n", 1)[1] if kind == "response" and b"\r\n\r\n" in block else None
                    known = payload is not None
                    rows.append(
                        [*(headers.get(h) for h in _HEADERS), block.decode("utf-8", "replace") if kind == "metadata" else None]
                        + [len(payload) if known else None, base64.b32encode(hashlib.sha1(payload).digest()).decode() if known else None, payload if with_payload else None]
                    )
                for lo in range(0, len(rows), 512):
                    cols = zip(*rows[lo : lo + 512])
                    kinds = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=RECORD.names)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row (RECORD) for each record of the archives under path. Digest and length of a payload are those of the bytes read."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_records(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, record_type, target_uri, page_id, refers_to_page_id, payload_bytes, payload_digest, payload,
    request and metadata (structs, null if there is none).

    Requests and metadata are joined through their concurrent-to identifier. A revisit has the payload facts of the response that it refers
    to, and null ones if that isn't there. Records that repeat a record id count once; records that concern no capture are left out.
    """
    kind = F.col("record_type")
    capture = F.struct("record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload")
    side = F.struct(F.col("record_id").alias("id"), "target_uri", "date", "fields")
    transaction = F.when(kind.isin("request", "metadata"), F.col("concurrent_to")).otherwise(F.col("record_id")).alias("transaction")
    joined = records.where(transaction.isNotNull()).groupBy(transaction).agg(
        F.max(F.when(kind.isin("response", "revisit"), capture)).alias("c"), F.min(F.when(kind == "request", side)).alias("request"), F.min(F.when(kind == "metadata", side)).alias("metadata")
    )
    number = F.regexp_extract(F.col("metadata.fields"), r"page-id: (-?\d+)", 1)
    full = joined.where("c is not null").select("c.*", F.when(number != "", number.cast("long")).alias("page_id"), "request", "metadata")
    responses = full.where("record_type = 'response'")
    facts = ("payload_bytes", "payload_digest", "payload")
    out = ["record_id", "record_type", "target_uri", "page_id", "refers_to_page_id", *facts, "request", "metadata"]
    # only revisits are joined: responses refer to nothing, and would all meet at one key
    source = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_to_page_id"), *facts)
    again = full.where("record_type = 'revisit'").drop(*facts).join(source, "refers_to", "left")
    return responses.withColumn("refers_to_page_id", F.lit(None).cast("long")).select(*out).unionByName(again.select(*out))
