import gzip
import hashlib
import random

import pyarrow as pa
import pytest

from tessera.llm import warc

PAGES = "page_id long, url string, html string, value string"


def rows_of():
    big, huge = "x" * 1000, "é" * 5000
    return [
        (1, "http://b.example.com/1", big), (2, "http://a.example.com/2?q=1#f", big), (3, "https://a.example.com/2?q=1", "x" * 999), (4, None, "x" * 999), (5, "http://c\r\nX: y/", None),
        (6, "no scheme", ""), (7, "http://b.example.com/1", huge), (8, "http://b.example.com/1", huge), (9, "http://b.example.com/1", huge), (None, "http://z/", big), (10, "http://z/", "WARC/1.0\r\n\r\nWARC-Type: response\r\n\r\n"), (11, "http://z/", "line\n\r\n\r\n"),
    ]


def want(rows):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        head = max((j for j in same if j is not None), default=None)
        again = len(raw) >= 1000 and len(same) > 1 and head is not None and head != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = rows_of()
    got = warc.round_trip(spark.createDataFrame([(*x, "v") for x in rows], PAGES)).collect()
    assert sorted([(x.id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got], key=repr) == want(rows)
    keys = [(x.url_key.encode(), x.ts, x.id is not None, x.id or 0) for x in got]
    assert keys == sorted(keys)  # histories are in global order across partitions
    assert next(x for x in got if x.id == 2).url_key == "com,example,a)/2?q=1"


def test_empty_and_repeated(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(3, "http://a/", "y" * 1200, "v")] * 2
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert [x.record_type for x in got] == ["response", "response"]


def test_broken_archives():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"abc").hexdigest().encode() + b"\r\nContent-Length: 7\r\n\r\n"
    good = record + b"\r\n\r\nabc\r\n\r\n"
    assert [r["payload"] for r in warc.parse_archive(gzip.compress(good * 3))] == [b"abc"] * 3
    assert list(warc.parse_archive(b"")) == []
    for bad in (good.replace(b"abc", b"abd"), good[:-2] + b"xx", b"junk" + good):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 20])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(((r.randint(0, 30),), (i, j)) for j in range(r.randint(0, 20))) for i in range(k)]
    got = list(warc.LoserTree([iter(x) for x in runs]))
    assert [x[0] for x in got] == sorted(x[0] for run in runs for x in run)
    assert sorted(got) == sorted(x for run in runs for x in run)


@pytest.mark.parametrize("fan_in", [2, 128])
def test_merge_of_many_runs(fan_in):
    r = random.Random(4)
    rows = []
    for run in range(9):
        own = [{"url_key": r.choice("abc"), "ts": str(r.randint(0, 9)), "id": r.randint(0, 99), "run": f"r{run}", "offset": k, "length": 1, "record_type": "response", "payload_digest": "", "payload_bytes": 0, "refers_to": None} for k in range(r.randint(1, 50))]
        rows += sorted(own, key=warc.order)
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 13], warc.CAPTURE) for i in range(0, len(rows), 13)]
    got = [x for b in warc.merge_runs(iter(batches), step=5, fan_in=fan_in) for x in b.to_pylist()]
    assert [warc.order(x) for x in got] == sorted(warc.order(x) for x in rows)


def test_archives_hold_a_bounded_number_of_bytes(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "x" * n) for i, n in enumerate([10] * 30 + [300] * 9 + [5000] * 3)]
    pages = spark.createDataFrame([(*x, "v") for x in rows], PAGES).coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w", classes=((100, 10), (1000, 4), (None, 1)))
    held = {}
    for f in tmp_path.glob("w/*/*.gz"):
        held.setdefault(f.parent.name, []).append(len(list(warc.parse_archive(f.read_bytes()))))
    assert {k: sorted(v) for k, v in held.items()} == {"0": [10, 10, 10], "1": [1, 4, 4], "2": [1, 1, 1]}
