"""WARC archives written and read by Spark, and capture histories from an external index merge."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import as_list
from pagequarry.session import materialize, stage_root

CRLF = "\r\n"
#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_REVISIT = 100
#: Bytes of records that an archive file gets, about.
FILE_BYTES = 16 << 20
#: Index entries that a merge task gets, about.
RUN_ENTRIES = 50_000
_ID = "urn:page:"
INDEX = (
    "url_key string, captured string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "file string, record_offset bigint, record_bytes bigint"
)


def _line(name: str, value: Column) -> Column:
    """A header line; control characters of the value are percent-encoded."""
    clean = F.replace(F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\x00"), F.lit("%00"))
    return F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF))


def with_revisits(pages: DataFrame) -> DataFrame:
    """Add payload_bytes, payload_digest and refers_to (the smallest page_id with an equal payload, for all but that page).

    Only digests are grouped, pre-aggregated per task; digests that occur once don't reach the join. Of repeated
    rows with the smallest page_id each is a response. Rows without a page_id neither are nor make revisits.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "captured", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    narrow = materialize(rows.select("page_id", "payload_bytes", "payload_digest"), "payloads")
    # A small table of repeated digests is broadcast by Spark, so payloads aren't shuffled for it; a large one is joined by digest.
    several = materialize(
        narrow.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "repeated-payloads",
    )
    first = F.when((F.col("payload_bytes") >= LEAST_REVISIT) & (F.col("page_id") > F.col("first_page")), F.col("first_page"))
    return rows.join(several, "payload_digest", "left").withColumn("refers_to", first).drop("first_page")


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record): the text of a WARC/1.1 record without the two line ends that close it.

    A response holds an HTTP head and the payload; a revisit holds the head alone and names the response.
    """
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    with_block = pages.withColumn("block", block)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), F.when(revisit, F.lit(f"WARC-Type: revisit{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), page, F.lit(">"))),
        _line("WARC-Date", F.coalesce(F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z"))),
        _line("WARC-Target-URI", F.coalesce("url", F.lit(""))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
            _line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"), _line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF),
    )
    return with_block.select("page_id", F.concat(head, "block").alias("record"))


def write_archives(records_: DataFrame, total_bytes: int, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write records as gzipped archive files of about ``file_bytes`` each before compression: the closing line ends are the separator of Spark's text writer.

    Records are dealt at random by their own hash, so equal pages don't meet in one file.
    """
    files = max(1, -(-total_bytes // file_bytes))
    dealt = records_.repartition(files, F.xxhash64("page_id", F.substring("record", 1, 400)))
    dealt.select(F.col("record").alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """A key that sorts captures of a host together: host labels reversed, then path and query, lower-case, without scheme, www and fragment."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}".lower()


_FIELD = re.compile(rb"^([\w-]+): ?(.*)$", re.M)


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, bytes, header fields, block) of each record of an uncompressed archive file; lengths come from the headers, never from separators."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = {k.decode().lower(): v.rstrip(b"\r").decode("utf-8", "replace") for k, v in _FIELD.findall(data[at:end])}
        start, size = end + 4, int(fields["content-length"])
        yield at, start + size + 4 - at, fields, data[start:start + size]
        at = start + size + 4


def _page(text: str | None) -> int | None:
    number = (text or "").strip("<>").removeprefix(_ID)
    return int(number) if number.lstrip("-").isdigit() else None


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in INDEX.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    types = [kinds[x.split(" ")[1]] for x in INDEX.split(", ")]
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            run = []
            for offset, size, fields, block in read_records(gzip.decompress(data.as_py())):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind = fields["warc-type"]
                length = int(dict(_FIELD.findall(head))[b"Content-Length"])
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response":
                    found = hashlib.sha256(payload).hexdigest()
                    if found != digest or len(payload) != length:
                        raise ValueError(f"{path}: the record at {offset} doesn't have the payload that it names")
                run.append((
                    url_key(fields["warc-target-uri"]), fields["warc-date"], _page(fields["warc-record-id"]), kind, _page(fields.get("warc-refers-to")),
                    length, digest, path, offset, size))
            run.sort(key=_order)
            if run:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*run, strict=True), types, strict=True)], names)


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[7], entry[8]


def read_index(spark, path: str) -> DataFrame:
    """An index entry for each record of the archives; each file's entries form a sorted run. Payloads are checked against their digests."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").where("length(content) > 0")
    return files.mapInArrow(_read_files, INDEX)


class LoserTree:
    """Merges sorted runs: each inner node keeps the run that lost there, so the next entry costs one comparison a level."""

    def __init__(self, runs: list[Iterator[tuple]], key) -> None:
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads = [self._take(i) for i in range(len(runs))] or [None]
        self.lost = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.lost[node] = (b, a) if self._after(a, b) else (a, b)
        self.first = winners[1] if self.k > 1 else 0

    def _take(self, run: int) -> tuple | None:
        entry = next(self.runs[run], None)
        return None if entry is None else (self.key(entry), run, entry)

    def _after(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is None or (y is not None and y[:2] < x[:2])

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.first] is not None:
            run = self.first
            yield self.heads[run][2]
            self.heads[run] = self._take(run)
            winner, node = run, (run + self.k) // 2
            while node:
                if self._after(winner, self.lost[node]):
                    winner, self.lost[node] = self.lost[node], winner
                node //= 2
            self.first = winner


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of one key range; a range has about ``RUN_ENTRIES`` entries."""
    runs: dict[bytes, list[tuple]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for entry in zip(*(as_list(c) for c in batch.columns), strict=True):
            runs.setdefault(entry[7], []).append(entry)
    if schema is None:
        return
    names = schema.names
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [
            pa.array(c, pa.binary()).cast(pa.string()) if pa.types.is_string(schema.field(n).type) or pa.types.is_large_string(schema.field(n).type) else pa.array(c, pa.int64())
            for n, c in zip(names, zip(*rows, strict=True), strict=True)
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    for entry in LoserTree([iter(r) for r in runs.values()], _order):
        out.append(entry)
        if len(out) == 10_000:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def capture_history(index: DataFrame) -> DataFrame:
    """The index entries in global order of (url_key, captured, page_id): ranges in order, and each range merged from the sorted runs.

    Ranges are cut at sampled keys of url, time and page, so captures of one very common url spread over ranges. Within
    a range each archive's entries arrive as a run (sorted by file first) and a loser tree merges the runs.
    """
    runs = materialize(index, "index-runs")
    ranges = max(1, -(-runs.count() // RUN_ENTRIES))
    order = ["url_key", "captured", "page_id"]
    dealt = runs.repartitionByRange(ranges, *order).sortWithinPartitions("file", *order, "record_offset")
    return dealt.mapInArrow(_merge, INDEX)


def archive(pages: DataFrame, label: str = "warc") -> str:
    """Write the pages (page_id, url, html, captured) as WARC files below the shared folder; returns the path."""
    import uuid

    spark = pages.sparkSession
    path = f"{stage_root(spark).rstrip('/')}/pagequarry-stages/{label}-{uuid.uuid4().hex}"
    revisits = with_revisits(pages)
    total = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 600).alias("n")).first().n or 0
    write_archives(records(revisits), total, path)
    return path


def warc_query(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from its archives through the merged index."""
    captured = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10_000_000)))
    path = archive(pages.select("page_id", "url", "html", captured.alias("captured")))
    history = capture_history(read_index(pages.sparkSession, path))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id > first_page THEN first_page END AS refers_to
FROM f
"""
