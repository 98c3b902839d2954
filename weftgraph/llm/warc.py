"""WARC archives with revisit records, and a capture index merged from locally sorted runs."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.bitmaps import split
from weftgraph.operators.prefix import starts_of
from weftgraph.operators.skew import join_facts
from weftgraph.session import shared_dir, stash

#: Bytes of records in one archive as a rule and at most (unless one record alone is longer), and index rows in one
#: partition of the merge.
ARCHIVE_BYTES, MOST_BYTES, MERGE_ROWS = 32_000_000, 256_000_000, 50_000
#: Payloads below this are always stored.
LEAST_REVISIT = 100
#: Captures carry no time of their own in a table of pages; ids count seconds from this one.
EPOCH = 1_577_836_800
_ID = "urn:weft:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def find_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, refers_to) of each page that repeats the payload of one with a smaller id.

    Only payloads of LEAST_REVISIT bytes or more count. Counts and smallest ids are combined before the shuffle, so a
    payload shared by a third of all pages is one row for each task, and its fact is broadcast to its pages.
    """
    narrow = stash(pages.select("page_id", *_payload()).where(F.col("payload_bytes") >= LEAST_REVISIT))
    facts = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = join_facts(narrow.select("page_id", "payload_digest"), stash(facts), "payload_digest", "_n", "inner")
    return found.where("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def _payload() -> list:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return [F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes")]


def write_archives(pages: DataFrame, path: str, compression: str = "none") -> None:
    """One WARC/1.1 record for each row of ``pages(page_id, url, html)`` under ``path``.

    The text sink writes records as they are, and the blank lines that end a WARC record are its line separator; so
    archives go to any file system that Spark writes to. Without compression an index's offset is where a record begins
    in its file, so one record can be fetched alone; with ``gzip`` a file is one member and offsets are of its content.
    Payloads leave the JVM once. A bitmap of the revisits' ids tells which pages have to meet the list of revisits; only
    these are shuffled, no others.
    """
    revisits = stash(find_revisits(pages).withColumnRenamed("page_id", "_id").withColumnRenamed("payload_digest", "_digest"))
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), *_payload())
    those, others = split(rows, F.col("page_id"), revisits.select("_id"))
    those = those.join(revisits, (F.col("page_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    rows = those.select(*rows.columns, "refers_to").unionByName(others.withColumn("refers_to", F.lit(None).cast(revisits.schema["refers_to"].dataType)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    again = F.col("refers_to").isNotNull()
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod("page_id", F.lit(2**31)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit("WARC/1.1" + _CRLF + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{_CRLF}WARC-Record-ID: <{_ID}"), text("page_id"), F.lit(f">{_CRLF}WARC-Target-URI: "), url,
        F.lit(f"{_CRLF}WARC-Date: "), when, F.lit(f"{_CRLF}WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(again, F.concat(F.lit(f"{_CRLF}WARC-Profile: {_PROFILE}{_CRLF}WARC-Refers-To: <{_ID}"), text("refers_to"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(_CRLF * 2), http, body)
    size = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
    mean, most = pages.agg(F.coalesce(F.avg(size), F.lit(0.0)), F.coalesce(F.max(size), F.lit(0))).first()
    records = max(1, min(int(ARCHIVE_BYTES / (mean + 600)), MOST_BYTES // (most + 600)))
    rows.select(record.alias("value")).write.option("lineSep", _CRLF * 2).option("compression", compression).option(
        "maxRecordsPerFile", records).text(path)


def url_key(url: str) -> str:
    """The host's labels from last to first, then the path and query in lower case; no scheme, www. or fragment."""
    bare = re.sub(r"^[a-z]+://", "", url.split("#", 1)[0].lower())
    bare = bare[4:] if bare.startswith("www.") else bare
    host, slash, path = bare.partition("/")
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """(offset, headers, HTTP headers, body) of each record; header names in lower case."""
    offset = 0
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        at, offset, headers = offset, offset + len(first), {}
        while (line := stream.readline()).strip():
            offset += len(line)
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(size := int(headers["content-length"]))
        end = stream.read(4)
        if len(block) != size or end != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        offset += len(line) + size + 4
        head, _, body = block.partition(b"\r\n\r\n")
        http = dict((n.strip().lower(), v.strip()) for n, _, v in (x.partition(":") for x in head.decode().split(_CRLF)[1:]))
        yield at, headers, http, body


_RUN = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RUN_DDL = "run string, url_key string, stamp string, page_id long, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _index_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive's captures as a run sorted by URL key, time and id; every stored payload's digest is checked."""
    number = lambda x: int(x) if x else None
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            run = []
            raw = pa.BufferReader(content.as_buffer())
            packed = content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b"
            for at, head, http, body in read_records(io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw)):
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                size = int(http["content-length"])
                if head["warc-type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"{path} at {at}: the payload does not have its digest")
                bare = lambda k: head.get(k, "").strip("<>").removeprefix(_ID)  # noqa: B023, E731
                run.append((path, url_key(head["warc-target-uri"]), head["warc-date"], number(bare("warc-record-id")), at, size, digest, head["warc-type"], number(bare("warc-refers-to"))))
            run.sort(key=_order)
            yield _batch(run, _RUN)


def _order(row: tuple) -> tuple:
    return row[1], row[2], -(2**63) if row[3] is None else row[3], row[7], row[0], row[4]


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step replays one path to the root."""

    def __init__(self, runs: list[Iterator], key):
        self.key, self.runs, self.k = key, runs, max(1, len(runs))
        self.heads: list = [self._next(i) for i in range(len(runs))] + [None] * (self.k - len(runs))
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # while building: wait here for the other side
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while (head := self.heads[top := self.losers[0]]) is not None:
            yield head[1]
            self.heads[top] = self._next(top)
            self._play(top)


_PLACED = pa.schema([*_RUN, ("part", pa.int32()), ("place", pa.int64())])


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of keys: its rows come run by run, each run sorted; they leave in global order."""
    runs: dict[str, list[tuple]] = {}
    part = None
    for batch in batches:
        if batch.num_rows:
            part = batch["part"][0].as_py()
            for row in zip(*(batch[f.name].to_pylist() for f in _RUN)):
                runs.setdefault(row[0], []).append(row)
    if part is None:
        return
    merged = list(LoserTree([iter(r) for r in runs.values()], _order))
    for i in range(0, len(merged), 10_000):
        yield _batch([(*row, part, i + k) for k, row in enumerate(merged[i : i + 10_000])], _PLACED)


def merged_index(spark: SparkSession, path: str) -> DataFrame:
    """The capture index of the archives under ``path``, in global order of URL key, time and id.

    Each archive gives a sorted run. Runs are cut at common splitters over key, time and id (so a URL with very many
    captures is split as well), each range gets its share of every run and merges these with a loser tree; a range
    holds about MERGE_ROWS rows. ``cdx_position`` counts from 0 over all captures: a range's start is the sum of the
    sizes of those before it, summed in two levels.
    """
    found = stash(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_index_archives, _RUN_DDL))
    parts = max(1, -(-found.count() // MERGE_ROWS))
    order = ["url_key", "stamp", F.col("page_id").asc_nulls_first(), "record_type", "run", "offset"]
    ranged = found.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("run", *order)
    merged = stash(ranged.mapInArrow(_merge_runs, _RUN_DDL + ", part int, place long"))
    starts = starts_of(merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "n")
    placed = merged.join(starts.withColumnRenamed("n", "_start"), "part")
    return placed.withColumn("cdx_position", F.col("_start") + F.col("place")).drop("part", "place", "_start")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write every page to archives, read them back and return one row for each: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url_key, cdx_position.

    A null html is an empty payload, a null url an empty one. Rows that share the smallest id of a payload are all
    stored; other repeated rows are revisits. A null id is never a revisit and never referred to. Empty input gives an
    empty result. Extra columns are ignored.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return merged_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "cdx_position")


WARC_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(url, '#.*$', '', 's')), '^[a-z]+://', ''), '^www\\.', '') AS bare,
    min(CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN page_id END) OVER (PARTITION BY payload_digest) AS first_id FROM p
), s AS (
  SELECT *, array_to_string(list_reverse(string_split(split_part(bare, '/', 1), '.')), ',') || ')' || substr(bare, length(split_part(bare, '/', 1)) + 1) AS url_key FROM k
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key, page_id) - 1 AS cdx_position
FROM s
"""
