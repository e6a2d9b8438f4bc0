"""WARC archives without repeated payloads.

Headers (id, URL, digest, length) are written once and shuffled by payload digest,
without payloads; each digest's record of the largest id is the original, the
rest become revisit records that refer to it. Archives are then written anew with
fresh headers: one payload of each digest is joined to the response that needs
it, revisits carry none. Copies of a header are counted in their task, the largest
id of a digest is combined before the shuffle, and the join back to the headers is
one that Spark splits where a digest is hot.

A file holds whole WARC/1.1 records, gzip-compressed. Spark's text writer ends
each cell with the two line ends that end a WARC record, so the files are
committed like any other output, on any store.

Defined cases: a null payload is empty; equal payloads are equal in SHA-1 and
length; a null id takes part and is the original only if no copy has an id;
of rows of one id and payload the one of the largest URL is the original, of
equal rows any one, the others revisit it; every record has an id of its own, of
page id, digest and copy; a null URL is left out;
line ends in a URL are percent-encoded; an empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.common import row_batches
from rowferry.scratch import materialize

END = "\r\n\r\n"
RECORDS_PER_FILE = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:rowferry:page:"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's bytes: 40 hex digits, 5 at a time to 4 of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """page_id, url, payload, payload_digest and payload_bytes of each row."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    return rows.withColumns({
        "payload_digest": base32_sha1(F.col("payload")),
        "payload_bytes": F.octet_length("payload").cast("long"),
    })


HEADER = ["page_id", "url", "payload_digest", "payload_bytes", "part"]


def headers(rows: DataFrame) -> DataFrame:
    """Each header that a task has seen, and how many copies of it."""
    seen = rows.drop("payload").withColumn("part", F.spark_partition_id())
    return seen.groupBy(*HEADER).agg(F.count(F.lit(1)).alias("copies"))


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """headers with the original of their payload (original, original_url, original_part) and whether they are it (first).

    Payloads of fewer than least_bytes bytes are originals each.
    """
    key = ["payload_digest", "payload_bytes"]
    large = headers.where(F.col("payload_bytes") >= least_bytes)
    # Of equal ids the largest URL, of equal ones the largest part; nulls are the smallest.
    best = large.groupBy(*key).agg(F.max(F.struct("page_id", "url", "part")).alias("best"))
    joined = headers.join(best, key, "left")
    return joined.select(
        *HEADER, "copies", F.col("best.page_id").alias("original"), F.col("best.url").alias("original_url"),
        F.col("best.part").alias("original_part"), (F.col("payload_bytes") < least_bytes).alias("alone"),
        F.col("best").eqNullSafe(F.struct("page_id", "url", "part")).alias("first"),
    )


def _clean(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record_id(page_id: Column, url: Column, part: Column, copy: Column) -> Column:
    """Page id, digest of what else tells records of a page apart, and number of the copy."""
    rest = F.sha1(F.concat_ws(" ", F.col("payload_digest"), part.cast("string"), url))
    return F.concat(
        F.lit(f"<{RECORD_ID}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit("/"),
        F.substring(rest, 1, 20), F.lit("/"), copy.cast("string"), F.lit(">"),
    )


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
) -> None:
    """Write one record for each row of pages: a response, or a revisit of the same payload's response."""
    rows = records(pages, id_col, url_col, payload_col)
    fates = materialize(resolve(materialize(headers(rows), "warc-headers"), least_bytes), "warc-fates")
    each = fates.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    is_response = F.col("alone") | (F.col("first") & (F.col("copy") == 1))
    key = ["payload_digest", "payload_bytes"]
    payloads = rows.groupBy(*key).agg(F.any_value("payload").alias("payload"))
    responses = each.where(is_response).join(payloads, key).withColumn("first", F.lit(True))
    revisits = each.where(~is_response).withColumns({"payload": F.lit(""), "first": F.lit(False)})
    first = F.col("first")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    block = F.when(first, F.concat(http, F.col("payload"))).otherwise(http)
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    original = _record_id(F.col("original"), F.col("original_url"), F.col("original_part"), F.lit(1))
    value = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(first, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\n"),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("part"), F.col("copy"))),
        _line("WARC-Date", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", _clean(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(~first, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(~first, original)),
        _line("WARC-Refers-To-Target-URI", F.when(~first, _clean(F.col("original_url")))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"), F.col("block"),
    )
    writer = responses.unionByName(revisits).withColumn("block", block).select(value.alias("value")).write
    options = {"lineSep": END, "compression": "gzip", "maxRecordsPerFile": RECORDS_PER_FILE}
    writer.options(**options).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, by the lengths they state."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        headers = {n.lower(): v.strip() for n, _, v in (line.partition(":") for line in lines)}
        size = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 8 + size


def unzip(data: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) if out else data


READ = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()),
    ("record_id", pa.string()), ("stated_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string()),
])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record. Digest and length are of the payload as read; null for revisits, which have none."""

    def page(record_id: str | None) -> int | None:
        number = (record_id or "").removeprefix(f"<{RECORD_ID}").partition("/")[0]
        return int(number) if number.removeprefix("-").isdigit() else None

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for h, block in parse(unzip(batch.column(0)[i].as_py())):
                    body = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                    digest = body is not None and base64.b32encode(hashlib.sha1(body).digest()).decode() or None
                    yield (
                        page(h.get("warc-record-id")), h["warc-type"], h.get("warc-target-uri"), h.get("warc-record-id"),
                        h.get("warc-payload-digest", "").removeprefix("sha1:"), page(h.get("warc-refers-to")),
                        h.get("warc-refers-to"), None if body is None else len(body), digest,
                        body.decode() if payloads and body is not None else None,
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(
        lambda b: row_batches(rows(b), READ, lambda r: len(r[9] or "") + 128),
        "page_id long, record_type string, target_uri string, record_id string, stated_digest string, refers_to long, "
        "refers_to_record string, payload_bytes long, payload_digest string, payload string",
    )


def resolved(read: DataFrame) -> DataFrame:
    """Records with digest and length of the full payload: revisits take them from their original response."""
    responses = read.where("record_type = 'response'")
    own = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    originals = responses.groupBy(
        F.col("page_id").alias("original"), F.col("payload_digest").alias("digest")
    ).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    found = revisits.join(
        originals,
        revisits.refers_to.eqNullSafe(originals.original) & (revisits.stated_digest == originals.digest),
        "left",
    )
    return own.unionByName(
        found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    )
