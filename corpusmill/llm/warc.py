"""WARC archives: writing captures, reading them back, and assembling transactions.

Each page is one capture of three records: request, response (or revisit) and metadata. Request and
metadata name the response in WARC-Concurrent-To; the reader joins the three through it and gives one
nested row per capture. Equal payloads of ``least`` bytes or more are stored once, with the smallest
page_id; the other captures are revisits, which name that record in WARC-Refers-To. The reader finds size,
digest and page of a revisit through this record id, and fails where it is missing or where a declared
digest is not that of the payload.

Archives are written and read by Spark's own sinks and sources, so any store that Spark knows will do:
the text sink ends each record with the two line breaks the format asks for.

Defined results: a null html is an empty payload; a null url is archived as ``urn:page:<page_id>``;
rows that repeat the smallest page_id of a payload are all responses, with record ids of their own, and
one of them is referred to; without any page_id in a group of equal payloads all are responses; an empty
table gives an empty archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

LEAST_BYTES = 100
CRLF = "\r\n"
WARC_DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive file holds about this many bytes before compression.
FILE_BYTES = 24_000_000
#: First carriers of repeated payloads up to this many rows (about 150 bytes each) are broadcast.
BROADCAST_ROWS = 100_000


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, rid: Column, mime: str, block: Column, more: list[tuple[str, Column]]) -> Column:
    """A record without the two line breaks at its end. Headers with a null value are left out."""
    lines = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(WARC_DATE)), *more, ("Content-Type", F.lit(mime))]
    lines.append(("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in lines]), F.lit(CRLF * 2), block)


def _payload() -> Column:
    return F.coalesce("html", F.lit(""))


def write_archive(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Write all pages as gzipped WARC files below ``path``."""
    named = pages.select("page_id", F.coalesce(F.regexp_replace("url", r"[\x00-\x20]", ""), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).alias("url"), _payload().alias("html"))
    named = named.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("long"), "row": F.monotonically_increasing_id()})
    named = store.keep(named, "warc-rows")  # written out, so that row numbers and record ids stay
    total = named.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    carrier = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "url"))).alias("first")
    firsts = named.filter(F.col("bytes") >= least).groupBy("digest").agg(carrier, F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    firsts = store.keep(firsts.select("digest", "first"), "warc-firsts")
    joined = named.join(store.small(firsts, firsts.count(), BROADCAST_ROWS), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first.page_id"), F.lit(False))
    joined = joined.withColumn("revisit", revisit)

    def record_id(page: Column, row: Column) -> Column:
        return _urn(F.lit("capture"), page.cast("string"), F.col("digest"), row.cast("string"))

    joined = joined.withColumn("rid", record_id(F.col("page_id"), F.col("row")))
    uri = ("WARC-Target-URI", F.col("url"))
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    target = F.regexp_replace("url", r"^[a-zA-Z]+://[^/?#]*", "")
    request = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    to = F.when(F.col("revisit"), record_id(F.col("first.page_id"), F.col("first.row")))
    more = [uri, digest, ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))), ("WARC-Refers-To", to), ("WARC-Refers-To-Target-URI", F.when(F.col("revisit"), F.col("first.url")))]
    response = _record(F.when(F.col("revisit"), "revisit").otherwise("response"), F.col("rid"), "application/http;msgtype=response", body, more)
    beside = [uri, ("WARC-Concurrent-To", F.col("rid"))]
    fields = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(CRLF))
    records = F.array(
        _record("request", _urn(F.lit("request"), F.col("rid")), "application/http;msgtype=request", request, beside), response,
        _record("metadata", _urn(F.lit("metadata"), F.col("rid")), "application/warc-fields", fields, beside),
    )
    mean = (total[1] or 0) / max(1, total[0]) + 1500
    lines = joined.select(F.explode(records).alias("value"))
    sink = lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(3, 3 * int(FILE_BYTES / mean)))
    sink.text(path)
    store.discard(named)


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an unpacked WARC file."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "surrogateescape").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        yield head, raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


RECORD = "kind string, record_id string, concurrent_to string, target_uri string, declared_digest string, refers_to_record string, block_bytes long, payload_bytes long, payload_digest string, page_id long"


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record. ``payloads``: with a binary column ``payload`` of responses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                rows = []
                for head, block in parse_records(gzip.decompress(raw)):
                    kind = head["warc-type"]
                    fields: dict[str, str] = {}
                    payload = None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if ": " in x)
                    number = lambda k, f=fields: int(f[k]) if k in f else None
                    rows.append(
                        (
                            kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha256:") or None, head.get("warc-refers-to"), len(block),
                            None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest(), number("page_id"), *([payload] if payloads else []),
                        )
                    )
                names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payloads
                out = pd.DataFrame(rows, columns=names)
                for c in ("block_bytes", "payload_bytes", "page_id"):
                    out[c] = out[c].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(run, RECORD + ", payload binary" * payloads)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: structs request, response and metadata. A missing part is null."""
    cols = [c for c in records.columns if c != "concurrent_to"]
    whole = F.struct(*cols)
    response = records.filter(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("capture"), whole.alias("response"))

    def beside(kind: str) -> DataFrame:
        some = records.filter((F.col("kind") == kind) & F.col("concurrent_to").isNotNull())
        return some.groupBy(F.col("concurrent_to").alias("capture")).agg(F.min_by(whole, "record_id").alias(kind))

    return response.join(beside("request"), "capture", "left").join(beside("metadata"), "capture", "left")


def resolved(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of assembled captures; revisits found by record id."""
    flat = captures.select(
        "capture", "response.kind", "metadata.page_id", "response.payload_bytes", "response.payload_digest", "response.declared_digest", "response.refers_to_record",
    )
    flat = store.keep(flat, "warc-captures")
    asked = flat.filter("kind = 'revisit'").select(F.col("refers_to_record").alias("capture")).distinct()
    first = flat.filter("kind = 'response'").join(asked, "capture")
    first = first.select(F.col("capture").alias("refers_to_record"), F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    first = store.keep(first, "warc-referred")
    joined = flat.join(store.small(first, first.count(), BROADCAST_ROWS), "refers_to_record", "left")
    digest = F.coalesce("payload_digest", "first_digest")
    checked = (
        F.when(digest.isNull(), F.raise_error(F.concat(F.lit("a revisit refers to no record: "), F.coalesce("refers_to_record", F.lit("-")))))
        .when(digest != F.coalesce("declared_digest", digest), F.raise_error(F.concat(F.lit("declared digest differs: "), F.col("capture"))))
        .otherwise(digest)
    )
    return joined.select("page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), checked.alias("payload_digest"), F.col("kind").alias("record_type"), F.col("first_page").alias("refers_to"))


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive, read it back, assemble; per page what the archive says of it."""
    spark = pages.sparkSession
    path = path or store.fresh_path(spark, "warc")
    write_archive(pages, path)
    return resolved(assemble(store.keep(read_records(spark, path), "warc-records")))
