"""WARC archives with revisit resolution.

Headers (page, url, SHA-1 and size of the payload) are computed beside the
scan. Only they are shuffled by payload digest, where a grouped maximum,
combined map-side, finds the original of equal payloads of at least
``MIN_BYTES`` bytes. The originals join the pages by digest (AQE splits a hot
digest). Each page becomes one WARC/1.1 record with fresh headers: originals
as ``response`` with the payload, the others as ``revisit`` that name the
original. Spark's text writer puts the records into gzip archives in any
store it can write to; the line separator is the blank line that ends a
record.

Reading takes whole archives (bounded in bytes by ``ARCHIVES``), parses records by Content-Length, recomputes the digest
of every payload found and resolves revisits by a join on the record id.

Defined cases: a null html is an empty payload; a null url gives no target
URI; line ends in a url are percent-encoded. Null page ids: such a page is
archived under an empty page id and never is an original of others; read back
its id is null. Rows that repeat page id and payload: all but one are
revisits of the first. Other columns are not read. No pages give no records.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, path_kind
from .common import stored, table

MIN_BYTES = 1000
#: Payload bytes up to which pages share an archive, and records in one: 64 MB at most. Larger pages have an archive each.
ARCHIVES = ((16 << 10, 4000), (1 << 20, 64), (None, 1))
DATE = "2025-01-01T00:00:00Z"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """row, page_id, url, html, bytes, digest: a row per page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), html.alias("html"),
                        F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"),
                        F.monotonically_increasing_id().alias("row"))


def record_id(page: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws(":", page.cast("string"), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                           for x in (F.lit("-" if a > 1 else ""), F.substring(h, a, n))], F.lit(">"))


def resolve(head: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """head plus record_id, and original_id (of the response that stands for
    it) on revisits. Only digests that repeat are joined to the pages."""
    own = head.withColumn("record_id", record_id(F.col("page_id"), F.col("row")))
    first = stored(own.where((F.col("bytes") >= min_bytes))
                   .groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "row", "record_id", "url")).alias("o"),
                                                   F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("digest", "bytes", F.col("o.record_id").alias("original_id"),
                                          F.col("o.url").alias("original_url")), "originals")
    return own.join(first, ["digest", "bytes"], "left").withColumn(
        "original_id", F.when(F.col("original_id") != F.col("record_id"), F.col("original_id")))


def record(date: str = DATE) -> Column:
    """One record without the blank line that ends it."""
    revisit = F.col("original_id").isNotNull()
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.col("original_id")),
        line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("original_url"))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write deduplicated .gz archives below ``path``, in a folder for each class
    of page sizes, so that an archive's bytes are bounded and not only its
    records. The headers are stored first: numbers and record ids are made once."""
    head = stored(headers(pages), "headers")
    own = resolve(head, min_bytes)
    low = -1
    for k, (high, records) in enumerate(ARCHIVES):
        size = (F.col("bytes") > low) & (F.lit(True) if high is None else F.col("bytes") <= high)
        if not head.where(size).isEmpty():
            (own.where(size).select(record().alias("value"))
             .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{path}/size{k}"))
        low = high


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


RECORDS = ("record_id string, record_type string, page_id long, url string, refers_to_id string, "
           "header_digest string, payload binary, payload_bytes long, payload_digest string")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record; payload, its size and digest are null on revisits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                            ("url", pa.string()), ("refers_to_id", pa.string()), ("header_digest", pa.string()),
                            ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for b in batches:
            for raw in b.column(0):
                rows = []
                for head, block in parse(raw.as_py()):
                    full = head["warc-type"] == "response"
                    body = block[block.index(b"\r\n\r\n") + 4:] if full else None
                    page = head.get("x-page-id")
                    rows.append((head["warc-record-id"], head["warc-type"], int(page) if page else None,
                                 head.get("warc-target-uri"), head.get("warc-refers-to"),
                                 head.get("warc-payload-digest", "").removeprefix("sha1:"),
                                 body if payloads else None, len(body) if full else None,
                                 hashlib.sha1(body).hexdigest() if full else None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True)
    if path_kind(spark, path) is None:  # no page at all
        return spark.createDataFrame([], RECORDS)
    return files.load(path).select("content").mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits
    get size and digest from the original they name."""
    slim = stored(records.drop("payload"), "records")
    originals = slim.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("ob"), F.col("payload_digest").alias("od"))
    revisits = slim.where("record_type = 'revisit'").join(originals, "refers_to_id", "left").select(
        "page_id", F.col("ob").alias("payload_bytes"), F.col("od").alias("payload_digest"), "record_type", "refers_to")
    plain = slim.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(revisits)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "llm-warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(read_archives(spark, path, payloads=False))


SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d, b) AS o FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 1000 AND o <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND o <> page_id THEN o END AS refers_to
FROM q
"""
