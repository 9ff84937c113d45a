"""WARC archives of pages, and their merged capture index.

Archives are written by Spark's text writer, records ended by the two line ends the format asks for, so any file system that Spark reaches will do and a lost executor's files are written again. Records of like size share files, so that a file is bounded in bytes too. Pages with equal payloads are archived once; the others revisit the first. Reading an archive back gives index runs of each file, sorted by URL key, time and page. Runs are cut at common bounds and each range is merged by a loser tree over its slices of the runs; with the number of captures before each range, that gives every capture its place in one global order.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import few_rows, stage, staged_path

END = "\r\n\r\n"
LEAST_BYTES = 100  # payloads below are archived each time
FILE_RECORDS = 2000  # in an archive file, at most
FILE_BYTES = 64 << 20  # in an archive file, about at most; a greater record has a file of its own
EPOCH = datetime.datetime(2024, 1, 1)  # capture time of page 0 where none is given; each further page a second later
RANGE_ROWS = 50_000  # captures of a merged range, about
SAMPLE = 10  # index keys for each range that bounds are taken from, about


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then ")" and path with query; lower case, no scheme, port, leading www or fragment."""
    if not url:
        return ")/"
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return ")/" + url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


class LoserTree:
    """k sorted runs as one: each inner node keeps the loser of its match, the winner goes up; after a winner leaves, only its path is played again."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        self.winner = self._play(1) if runs else -1

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; spent runs come last, ties by run."""
        spent_a, spent_b = self.at[a] >= len(self.runs[a]), self.at[b] >= len(self.runs[b])
        if spent_a or spent_b:
            return not spent_a and spent_b or (spent_a == spent_b and a < b)
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._less(b, a):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.runs and self.at[w := self.winner] < len(self.runs[w]):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (w + self.k) // 2
            while node:
                if self._less(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """(record): each page's WARC record without its end.

    Pages are told apart by id; of equal payloads of ``least`` bytes or more the page with the least id is the response. Rows that repeat that id with that payload are responses too; a page without an id is never one that others refer to. Null html is the empty payload, a null URL an empty target.
    """
    start = int((EPOCH - datetime.datetime(1970, 1, 1)).total_seconds())
    time = F.col(time_col) if time_col else F.timestamp_seconds(F.lit(start) + F.coalesce(F.col(id_col), F.lit(0)) % 1_000_000_000)
    page = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x1F\x7F]", "").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
        F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    )
    page = page.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    long = page.filter(F.col("bytes") >= least)
    firsts = stage(long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first"), "payloads")
    joined = page.join(F.broadcast(firsts) if few_rows(firsts) else firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.col("bytes") >= least)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.coalesce("date", F.lit("1970-01-01T00:00:00Z"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("first"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string"),
        F.lit(END),
        http,
    )
    return joined.select(F.when(revisit, head).otherwise(F.concat(head, "payload")).alias("record"))


def write(pages: DataFrame, path: str | None = None, **options: object) -> str:
    """Write the archives under ``path`` (else in the shared folder), one folder for each class of record size; gives the path.

    Classes end at FILE_BYTES / FILE_RECORDS bytes, 16 times that, 256 times that and so on, and a class's files hold as many records as keep to both limits.
    """
    path = path or staged_path(pages.sparkSession, "warc")
    rows, unit = records(pages, **options), FILE_BYTES // FILE_RECORDS
    size = F.octet_length("record")
    most = rows.agg(F.max(size)).first()[0] or 0
    lower, upper = -1, unit
    while lower < most:
        part = rows.filter((size > lower) & (size <= upper)) if upper < most or lower >= 0 else rows
        part.write.option("lineSep", END).option("maxRecordsPerFile", max(1, min(FILE_RECORDS, FILE_BYTES // upper))).text(f"{path}/upto={upper}")
        lower, upper = upper, upper * 16
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """Each record's header fields, offset, length and block, by its Content-Length."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        lines = data[at:split].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = data[split + 4 : (end := split + 4 + int(head["Content-Length"]))]
        if len(block) != int(head["Content-Length"]) or data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield head, at, end + 4 - at, block
        at = end + 4


ENTRY = "url_key string, date string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long, length long"


def _page(name: str | None) -> int | None:
    return int(m[1]) if name and (m := re.fullmatch(r"<urn:page:(-?\d+)>", name)) else None


def index(spark: SparkSession, path: str) -> DataFrame:
    """The archives' index entries, each file's a run that is sorted by URL key, date and page. Payloads are hashed anew and must have the digest that the record names."""
    names = [x.split()[0] for x in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                for head, at, length, block in parse(content.as_buffer().to_pybytes()):
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    fields, payload = block.split(b"\r\n\r\n", 1)
                    size = int(fields.rsplit(b"Content-Length: ", 1)[1])
                    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{file.as_py()}: the payload at byte {at} is not what its record says")
                    url = head["WARC-Target-URI"]
                    rows.append((url_key(url), head["WARC-Date"], _page(head["WARC-Record-ID"]), size, digest, "revisit" if revisit else "response", _page(head.get("WARC-Refers-To")) if revisit else None, url, file.as_py(), at, length))
                rows.sort(key=_order)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if isinstance(k, int) else pa.string()) for c, k in zip(zip(*rows, strict=True), ("", "", 0, 0, "", "", 0, "", "", 0, 0), strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, ENTRY)


def _order(row: tuple) -> tuple:
    """URL key and date, then page (none first), file and offset."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def merged(entries: DataFrame) -> DataFrame:
    """All captures with range and place, their number in the global order of URL key, date and page, from 0. ``entries`` must be staged.

    Bounds between ranges are keys with date, page, file and offset, so one URL with many captures splits as well. They are taken from about SAMPLE keys a range, so a range stays near RANGE_ROWS however many there are; the driver holds those keys and a count for each range.
    """
    total = entries.count()
    ranges = max(1, -(-total // RANGE_ROWS))
    key = F.struct("url_key", "date", F.col("page_id").isNotNull().alias("has"), F.coalesce("page_id", F.lit(0)).alias("page"), "file", "offset")
    bounds: list = []
    if ranges > 1:
        some = entries.select(key.alias("k")).filter(F.pmod(F.xxhash64("k"), F.lit(max(1, total // (SAMPLE * ranges)))) == 0)
        keys = sorted(tuple(r[0]) for r in some.collect())
        bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)} if keys else set())
    names = [x.split()[0] for x in ENTRY.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in names), strict=True)
            of = [bisect.bisect_right(bounds, _order(r)) for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of, pa.int32())], names=[*names, "range"])

    placed = stage(entries.select(names).mapInArrow(cut, f"{ENTRY}, range int"), "capture-ranges")
    starts, at = {}, 0
    for r in sorted(placed.groupBy("range").count().collect()):
        starts[r["range"]] = at
        at += r["count"]

    def merge(group: pa.Table) -> pa.Table:
        keys = [_order(r) for r in zip(*(group.column(n).to_pylist() for n in names), strict=True)]
        runs: dict[str, list] = {}
        for i, k in enumerate(keys):
            runs.setdefault(k[4], []).append((k, i))
        # A file's entries may have come in several blocks; each is sorted, so they are runs of their own.
        split: list[list] = []
        for own in runs.values():
            cuts = [0, *(i for i in range(1, len(own)) if own[i] < own[i - 1]), len(own)]
            split += [own[a:b] for a, b in zip(cuts, cuts[1:])]
        order = [i for _, i in LoserTree(split)]
        start = starts[group.column("range")[0].as_py()]
        return group.take(pa.array(order)).append_column("place", pa.array(range(start, start + len(order)), pa.int64()))

    return placed.groupBy("range").applyInArrow(merge, f"{ENTRY}, range int, place long")


def archive(pages: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """Write the archives, read them back and merge their indexes: one row per page, with its place in the merged order.

    Nulls and repeated rows as in ``records``; equal keys, dates and pages are ordered by file and offset; no rows give no rows; other columns are ignored. A file of the archive is read whole by one task, so it is bounded in records and bytes, but for a single greater record.
    """
    spark = pages.sparkSession
    path = write(pages, path, **options)
    return merged(stage(index(spark, path), "capture-runs"))


#: url_key in SQL; the pages' addresses are well-formed.
_HOST = r"regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www[0-9]*\.', '')"
_PATH = r"regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(lower(coalesce(url, '')), '^[^?#]*\?([^#]*)', 1)"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest, row_number() OVER (ORDER BY array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END, page_id) - 1 AS place FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, place
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
