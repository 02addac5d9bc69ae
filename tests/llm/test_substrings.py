import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import substrings

SCHEMA = "doc_id long, text string, spans string, id string"


def brute(rows, length):
    seen = defaultdict(list)
    raw = [(t or "").encode() for _, t in rows]
    for k, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append((k, i))
    cover = [np.zeros(len(b), bool) for b in raw]
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                cover[k][i : i + length] = True
    out = []
    for (i, _), b, c in zip(rows, raw, cover, strict=True):
        kept = bytes(x for x, y in zip(b, c, strict=True) if not y)
        n_spans = int((c & ~np.concatenate([[False], c[:-1]])).sum()) if len(c) else 0
        out.append((i, len(b), int(c.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(3)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 25)))]
        for p in passages:
            if r.random() < 0.4:
                a = r.randint(0, 40)
                parts += [p[a : a + r.randint(5, 90)], word()]
        out.append((i, " ".join(parts)))
    out += [(n, None), (n + 1, ""), (n + 2, out[0][1]), (n + 3, out[0][1]), (n + 3, out[0][1]), (None, out[5][1]), (n + 4, "a" * 200), (n + 5, "ab" * 70), (n + 6, out[3][1] * 3)]
    return out


@pytest.mark.parametrize(("seed", "length", "gram", "most"), [(1, 20, 8, 4096), (2, 33, 5, 4096), (3, 20, 8, 1), (4, 64, 16, 2)])
def test_against_brute_force(spark, seed, length, gram, most):
    rows = rows_of(seed)
    df = spark.createDataFrame([(*x, "s", "t") for x in rows], SCHEMA)
    got = substrings.remove_repeats(df, length=length, gram=gram, most=most, block=3000).collect()
    assert sorted([(x.id, x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in got], key=repr) == brute(rows, length)


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 500)
    r = random.Random(9)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(1500))) for i in range(3)]
    rows.append((3, rows[0][1][300:900] + "x" + rows[1][1][450:700]))
    data = [t.encode() for _, t in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in rows]), "th": pa.array([0] * 4), "text": pa.array([t for _, t in rows])})
    for k in range(4):
        starts = set()
        for out in substrings._find(iter([batch.slice(k, 1)]), 40, 16):
            for s, w in zip(out.column("start").to_pylist(), out.column("windows").to_pylist(), strict=True):
                starts |= set(range(s, s + w))
        assert starts == set(range(len(data[k]) - 40 + 1))


def test_texts_without_repeats_stay_out_of_the_joins(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(90))) for i in range(300)]
    rows += [(None, rows[0][1]), (301, rows[1][1]), (302, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = substrings.remove_repeats(spark.createDataFrame([(*x, "s", "t") for x in rows], SCHEMA), length=40, gram=16)
        found = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted([(x.id, x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in found], key=repr) == brute(rows, 40)
    assert "Union" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "map" in plan.split("LeftOuter")[-1]
