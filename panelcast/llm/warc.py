"""WARC archives: writing captures with revisits, reading, and assembling transactions."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.shared import shared_folder, table

#: Payloads below this many bytes are always stored, never referred to.
REVISIT_BYTES = 100
#: Text of records that one archive holds, about; an archive is read by one task.
ARCHIVE_BYTES = 64 << 20
LINE = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIRST_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
RECORDS = (
    "type string, record_id string, concurrent_to array<string>, uri string, date string, refers_to string, "
    "header_digest string, http string, payload binary, payload_bytes long, payload_digest string"
)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with ``digest``, ``bytes`` and ``first_id``, the page that holds an equal payload.

    Equal payloads are counted by digest before anything is moved, and only digests that
    occur more than once are joined back. ``first_id`` is null for responses: payloads under
    the limit, and the page (or repeated rows of it) with the smallest id of its group.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html").withColumns(
        {"bytes": F.octet_length(payload).cast("long"), "digest": F.sha2(payload, 256)}
    )
    repeated = (
        rows.where(F.col("bytes") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("smallest"), F.count("*").alias("n"))
        .where("n > 1 AND smallest IS NOT NULL")
        .select("digest", "smallest")
    )
    first = F.when((F.col("page_id") != F.col("smallest")) & (F.col("bytes") >= REVISIT_BYTES), F.col("smallest"))
    return rows.join(repeated, "digest", "left").withColumn("first_id", first).drop("smallest")


def _record(kind: str | Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text; a null header is left out. The sink adds the last line end."""
    lines = [F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.lit(f"WARC/1.1{LINE}"), F.concat_ws(LINE, *lines), F.lit(2 * LINE), block, F.lit(LINE))


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a request, a response or revisit, and a metadata record for every page.

    Requests and metadata name their capture in ``WARC-Concurrent-To``. A revisit keeps
    the HTTP header, whose length is that of the full payload, and refers to the page that
    holds it. Null html is an empty payload, a null url is left out, a null
    page id is written as such and never referred to, repeated rows give repeated records;
    other columns are ignored. Archives are gzip files of about ``archive_bytes`` of text.
    """
    rows = with_revisits(pages)
    size = pages.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 1200).alias("b")).first()
    per_archive = max(1, int(archive_bytes * size["n"] / (size["b"] or 1)))
    name = lambda part, key: F.concat(F.lit(f"<urn:{part}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))
    key, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    clean_url = F.regexp_replace("url", r"[\r\n]", "")
    date = ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))
    uri = ("WARC-Target-URI", clean_url)
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    revisit = F.col("first_id").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(2 * LINE),
    )
    capture = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", name("page", key)),
            date,
            uri,
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(revisit, name("page", F.col("first_id")))),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        ],
        F.concat(http, F.when(revisit, "").otherwise(html)),
    )
    request = _record(
        "request",
        [
            ("WARC-Record-ID", name("request", key)),
            date,
            uri,
            ("Content-Type", F.lit("application/http; msgtype=request")),
            ("WARC-Concurrent-To", name("page", key)),
        ],
        F.concat(F.lit("GET "), F.coalesce(clean_url, F.lit("/")), F.lit(f" HTTP/1.1{2 * LINE}")),
    )
    metadata = _record(
        "metadata",
        [
            ("WARC-Record-ID", name("metadata", key)),
            date,
            uri,
            ("Content-Type", F.lit("application/warc-fields")),
            ("WARC-Concurrent-To", name("page", key)),
        ],
        F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(LINE)),
    )
    records = rows.select(F.concat(request, F.lit(LINE), capture, F.lit(LINE), metadata).alias("value"))
    options = {"lineSep": LINE, "compression": "gzip", "maxRecordsPerFile": str(per_archive)}
    records.write.options(**options).text(folder)


def parse_archive(content: bytes) -> Iterator[tuple]:
    """Records of one archive, plain or gzip in one or many members, by their declared lengths."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not _FIRST_LINE.match(line):
            continue  # line ends between records
        headers: list[tuple[str, str]] = []
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers.append((key.strip().lower(), value.strip()))
        one = dict(headers)
        block = stream.read(int(one.get("content-length") or 0))
        kind, http, payload = one.get("warc-type"), None, block
        if one.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
        yield kind, one, [v for k, v in headers if k == "warc-concurrent-to"], http, payload


def _read_files(with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for kind, one, concurrent, http, payload in parse_archive(bytes(content)):
                    declared = re.search(r"(?im)^content-length:\s*(\d+)", http or "")
                    full = int(declared[1]) if kind == "revisit" and declared else len(payload)
                    digest = (one.get("warc-payload-digest") or "").removeprefix("sha256:") or None
                    if kind != "revisit":
                        digest = hashlib.sha256(payload).hexdigest()
                    kept = payload if with_payload and kind != "revisit" else None
                    rows.append(
                        (kind, one.get("warc-record-id"), concurrent, one.get("warc-target-uri"), one.get("warc-date"))
                        + (one.get("warc-refers-to"), one.get("warc-payload-digest"), http, kept, full, digest)
                    )
                    held += len(payload)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    return read


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives in ``folder``.

    ``payload_digest`` is computed from the payload read; a revisit, which holds none, has
    the digest and length of the full payload from its headers.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInPandas(_read_files(with_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit, request and metadata.

    A request or metadata record belongs to the capture it names in
    ``WARC-Concurrent-To``, or that names it. Of several, the one with the smallest record
    id is kept and their number is given. Records that name no capture in the table
    are left out; a capture without partners has nulls and zeros. Captures with equal ids stay
    separate rows, each with the partners of that id.
    """
    captures = records.where("type IN ('response', 'revisit')")
    others = records.where("type IN ('request', 'metadata')")
    part = F.struct("record_id", "uri", "date", "http", F.col("payload_bytes").alias("bytes")).alias("part")
    named = others.select(F.explode("concurrent_to").alias("capture"), "type", part)
    naming = (
        captures.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("other"))
        .join(others.select(F.col("record_id").alias("other"), "type", part), "other")
        .select("capture", "type", "part")
    )
    ofkind = lambda kind, c: F.when(F.col("type") == kind, c)
    grouped = (
        named.unionByName(naming)
        .groupBy("capture")
        .agg(
            *[F.min_by(ofkind(k, F.col("part")), ofkind(k, F.col("part.record_id"))).alias(k) for k in ("request", "metadata")],
            *[F.count_distinct(ofkind(k, F.col("part.record_id"))).alias(f"{k}_records") for k in ("request", "metadata")],
        )
    )
    return captures.join(grouped, captures["record_id"] == grouped["capture"], "left").select(
        captures["record_id"],
        "type",
        "uri",
        "date",
        "refers_to",
        "payload",
        "payload_bytes",
        "payload_digest",
        "request",
        "metadata",
        *[F.coalesce(f"{k}_records", F.lit(0)).alias(f"{k}_records") for k in ("request", "metadata")],
    )


def op2_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Per page: the capture assembled from the archives that were written for it."""
    out = shared_folder(spark, "op2-warc")
    write_warc(table(spark, folder, "pages"), out)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    rows = assemble(read_warc(spark, out, with_payload=False))
    return rows.select(
        page(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"),
        F.col("request.record_id").alias("request_id"),
        F.col("metadata.record_id").alias("metadata_id"),
    )
