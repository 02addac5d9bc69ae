import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=1, b=10_000, least=20, percent=10):
    raw, goal = Counter(), Counter()
    for texts, count in ((t for _, t in docs), raw), (iter(target), goal):
        for t in texts:
            count.update(zlib.crc32(g.encode()) % b for g in grams(t, n)[1])
    S, T = sum(raw.values()), sum(goal.values())
    gain = {k: math.floor(1000 * math.log((goal[k] + 1) * (S + b) / ((raw[k] + 1) * (T + b)))) for k in raw}
    out = []
    for i, t in docs:
        words, g = grams(t, n)
        weight = sum(gain[zlib.crc32(x.encode()) % b] for x in g)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    asked = sorted((-x[4], x[0] is None, x[0] or 0) for x in out if x[1] >= least)[: percent * sum(x[1] >= least for x in out) // 100]
    return out, asked


def made(seed, rows):
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma7", "straße", "слово", "x" * 40, "z" * 700, "日本", "It", "a"]
    return [(i, "".join(r.choice(vocabulary) + r.choice([" ", "  ", "\n", ", ", "-"]) for _ in range(r.randint(0, 60)))) for i in range(rows)]


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (3, 97)])
def test_against_brute_force(spark, n, buckets):
    docs = made(1, 300) + [(1000, None), (1001, ""), (1002, " ,. "), (1003, "a " * 100_000), (1004, "q" * 300_000 + " b" * 30)]
    target = [t for _, t in made(2, 20)] + [None, ""]
    df = spark.createDataFrame([(i, t, "k", 1, 2.0) for i, t in docs], "doc_id long, text string, row string, score int, `a.b` double").repartition(3)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=buckets, percent=40).collect()
    want, asked = brute(docs, target, n, buckets, percent=40)
    assert {r.row.doc_id: (r.row.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got} == {x[0]: x for x in want}
    assert [(-r.score, r.row.doc_id) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(s, i) for s, _, i in asked]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(asked) + 1)) and got[0].row.text is not None and got[0].row["a.b"] == 2.0


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "one two three four five six " * 5
    docs = [(1, text)] * 5 + [(None, text)] * 5 + [(2, "few words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    empty = spark.createDataFrame([], "text string")
    got = importance.resample(df, empty, percent=50).collect()
    want, asked = brute(docs, [], percent=50)
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.row.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=lambda x: (x[0] is None, x[0] or 0)) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0)) and key
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len(asked) == 5
    assert importance.resample(df.limit(0), empty).count() == 0


def test_shift_is_combination():
    r = random.Random(4)
    shifts = importance.Shifts()
    parts = [(r.randbytes(r.randint(0, 50)), r.randbytes(r.choice([0, 1, 7, 300, 5000]))) for _ in range(60)]
    first, second = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    whole = shifts.over(first, np.array([len(b) for _, b in parts])) ^ second
    assert whole.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_query_is_the_contract(spark, tmp_path):
    docs, target = made(5, 200), [t for _, t in made(6, 10)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op12_importance_resampling(spark, str(tmp_path)).collect()
    want, asked = brute(docs, target)
    rank = {i: k for k, (_, _, i) in enumerate(asked, 1)}
    assert sorted(tuple(r) for r in got) == sorted((i, f, w, s, rank.get(i)) for i, _, f, w, s in want)
