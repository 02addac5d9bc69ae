"""WARC archives with revisit records, and a globally ordered capture index by external merging.

Writing. Archives hold pages of one size class and a bounded number of bytes. A page becomes one record; of equal payloads of at least `min_bytes` the largest id's is the
response and the others are revisits that name it. Archives are written by Spark's text writer (gzip), so
they can be in any store and a lost executor's files are written again; a record ends in the blank line
that the writer adds.

Reading. Every archive is one sorted capture run: its records are parsed, checked against their digests,
and sorted by URL key and timestamp. Runs are dealt out by ranges of the URL key; a task spools the runs'
parts in its range to sequential files and merges them with a loser tree, so histories come out in global
order of (URL key, timestamp, id) with one open batch a run in memory.

Defined results: a null payload is empty; a null URL has an empty key and no target header; null ids are
written as `null`, rank below all others and read back as null; line breaks in URLs are escaped; repeated
rows are records of their own (equal ids: one of them is the response); an empty table has no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialize, partitions, shared_dir
from tessera.llm.prefilter import split

EPOCH = datetime(2000, 1, 1, tzinfo=UTC)
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: Column) -> Column:
    """Host labels reversed, comma-joined, then `)` and the rest without scheme and fragment; lower-case host. Null: empty."""
    host = F.regexp_extract(url, r"(?s)^[^:/?#]*://([^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^(?:[^:/?#]*://[^/?#]*)?([^#]*)", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), rest), F.lit(""))


def _escaped(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def build_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Columns size (payload bytes) and value: the record up to, and without, its last line feed."""
    html = F.coalesce(pages[html_col], F.lit(""))
    base = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    # largest id per repeated payload, written first: the join has exchanges of its own, so one very frequent payload can be split
    heads = base.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head")
    heads = materialize(heads, "heads")
    some, alone = split(base, heads, "digest")  # small and single payloads need no partner and aren't shuffled
    joined = some.join(heads, "digest", "left").select(*base.columns, "head").unionByName(alone.withColumn("head", F.lit(None).cast("long")))
    revisit = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _escaped(F.col("url")), F.lit("\r\n")), F.lit(""))
    when = F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(1 << 33))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    common = F.concat(
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">\r\nWARC-Date: "), when, F.lit("\r\n"), target,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("size").cast("string"), F.lit("\r\nWARC-URL-Key: "), _escaped(url_key(F.col("url"))), F.lit("\r\n"),
    )
    response = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\n"), common, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.col("size") + len(HTTP)).cast("string"), F.lit("\r\n\r\n" + HTTP), F.col("html"), F.lit("\r\n\r"))
    again = F.concat(F.lit("WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"), common, F.lit("WARC-Refers-To: <urn:page:"), F.col("head").cast("string"), F.lit(">\r\nContent-Length: 0\r\n\r\n\r\n\r"))
    return joined.select("size", F.when(revisit, again).otherwise(response).alias("value"))


#: Payloads under so many bytes, and how many of them an archive holds at most: 64 MB, or one larger page.
CLASSES = ((64 << 10, 1000), (8 << 20, 8), (None, 1))


def write_archives(pages: DataFrame, path: str, classes=CLASSES, html_col: str = "html", **columns) -> None:
    """Archives under path, one folder for each class of payload sizes, so that an archive's bytes are bounded."""
    over = 0
    size = F.coalesce(F.octet_length(pages[html_col]), F.lit(0))
    records = build_records(pages, html_col=html_col, **columns)
    for k, (under, most) in enumerate(classes):
        own = records.where((F.col("size") >= over) & (F.col("size") < under) if under else F.col("size") >= over)
        if k == 0 or not pages.where(size >= over).isEmpty():
            own.select("value").write.option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/{k}")
        over = under


def parse_archive(raw: bytes) -> Iterator[dict]:
    """Records of an archive (gzip or plain): headers, place and payload (None for a revisit)."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at : body - 4].decode().split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        end = body + int(head["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where its length says")
        payload = None
        if head["WARC-Type"] == "response":
            payload = data[data.index(b"\r\n\r\n", body) + 4 : end]
            if f"sha1:{hashlib.sha1(payload).hexdigest()}" != head["WARC-Payload-Digest"]:
                raise ValueError(f"digest of the record at byte {at} is wrong")
        yield {"head": head, "offset": at, "length": end + 4 - at, "payload": payload}
        at = end + 4


CAPTURE = pa.schema([("url_key", pa.string()), ("ts", pa.string()), ("id", pa.int64()), ("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])
CAPTURE_SQL = "url_key string, ts string, id long, run string, offset long, length long, record_type string, payload_digest string, payload_bytes long, refers_to long"


def _page(value: str) -> int | None:
    text = value.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def order(row: dict) -> tuple:
    return row["url_key"].encode(), row["ts"], row["id"] is not None, row["id"] or 0, row["offset"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = []
            for r in parse_archive(raw.as_py()):
                h = r["head"]
                rows.append({
                    "url_key": h.get("WARC-URL-Key", ""), "ts": h["WARC-Date"], "id": _page(h["WARC-Record-ID"]), "run": name.rpartition("/")[2], "offset": r["offset"], "length": r["length"], "record_type": h["WARC-Type"],
                    "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(h["WARC-Payload-Length"]), "refers_to": _page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None,
                })
            rows.sort(key=order)
            yield pa.RecordBatch.from_pylist(rows, CAPTURE)


class LoserTree:
    """Tournament over sorted iterators: inner nodes keep losers, so each output replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [0] * max(k, 1)
        winner = [0] * (2 * k)
        for i in range(2 * k - 1, 0, -1):
            if i >= k:
                winner[i] = i - k
            else:
                a, b = winner[2 * i], winner[2 * i + 1]
                winner[i], self.tree[i] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winner[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) <= (y[0], b))

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[best := self.tree[0]] is not None:
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            node = (best + self.k) // 2
            while node:
                if self._before(self.tree[node], best):
                    best, self.tree[node] = self.tree[node], best
                node //= 2
            self.tree[0] = best


def merge_runs(batches: Iterator[pa.RecordBatch], step: int = 512, fan_in: int = 128) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run, then in order: spooled to a file a run, then merged; more than fan_in runs are first merged in groups."""
    folder = tempfile.mkdtemp()
    try:
        files: list[str] = []

        def fresh() -> tuple[str, pa.RecordBatchFileWriter]:
            name = f"{folder}/{len(files)}-{uuid.uuid4().hex}"
            return name, pa.ipc.new_stream(name, CAPTURE)

        def read(name: str) -> Iterator[tuple]:
            with pa.OSFile(name) as f:
                for b in pa.ipc.open_stream(f):
                    yield from ((order(r), r) for r in b.to_pylist())
            os.unlink(name)

        def write(rows: Iterator[tuple]) -> str:
            name, out = fresh()
            with out:
                held = []
                for _, r in rows:
                    held.append(r)
                    if len(held) == step:
                        out.write_batch(pa.RecordBatch.from_pylist(held, CAPTURE))
                        held = []
                if held:
                    out.write_batch(pa.RecordBatch.from_pylist(held, CAPTURE))
            return name

        run, out = None, None
        for batch in batches:
            names = batch.column("run").to_pylist()
            lo = 0
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[lo]:
                    if names[lo] != run:
                        if out:
                            out.close()
                        run = names[lo]
                        name, out = fresh()
                        files.append(name)
                    for a in range(lo, k, step):
                        out.write_batch(batch.slice(a, min(step, k - a)))
                    lo = k
        if out:
            out.close()
        while len(files) > fan_in:
            files = files[fan_in:] + [write(iter(LoserTree([read(f) for f in files[:fan_in]])))]
        held = []
        for _, r in LoserTree([read(f) for f in files]):
            held.append(r)
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, CAPTURE)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, CAPTURE)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def capture_index(archives: DataFrame) -> DataFrame:
    """path, content of archives -> captures in global order of URL key, timestamp and id: partitions are ranges in order, rows are in order within."""
    spark = archives.sparkSession
    runs = archives.select("path", "content").mapInArrow(_runs, CAPTURE_SQL)
    # ids beside the key: one very frequent URL is still dealt out
    dealt = runs.repartitionByRange(partitions(spark), "url_key", "ts", "id").sortWithinPartitions("run", "url_key", "ts", "id", "offset")
    return dealt.mapInArrow(merge_runs, CAPTURE_SQL)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Archives of all pages under the shared folder, read back to the capture index."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **columns)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return capture_index(archives)


def dates(first_id: int) -> str:
    """The date header of an id, for tests."""
    return (EPOCH + timedelta(seconds=first_id % (1 << 33))).strftime("%Y-%m-%dT%H:%M:%SZ")
