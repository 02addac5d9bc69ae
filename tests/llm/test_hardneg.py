import random

import numpy as np
import pytest

from tessera.llm import hardneg, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, size=5, low=80, high=100):
    live = []
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        live.append((i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    seen = set()
    for i, lab, c in live:
        if i % every or (i, lab, tuple(c)) in seen:
            continue
        seen.add((i, lab, tuple(c)))
        scored = sorted((-sum(x * y for x, y in zip(c, d, strict=True)), j, other) for j, other, d in live if j != i and len(d) == len(c))
        for s, j, _ in [x for x in scored if x[2] == lab][:size]:
            fit = [x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s][:size]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def close_rows(n, dim, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(6, dim))
    v = base[r.integers(0, 6, n)] + 0.4 * r.normal(size=(n, dim))
    return [(int(i), [float(np.float32(x)) for x in v[i] / np.linalg.norm(v[i])], int(r.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_against_brute_force(spark, block):
    rows = close_rows(900, 24, 1)
    rows += [(1000 + i, rows[5][1], i % 4) for i in range(60)]  # one hot vector under several labels: ties by id
    got = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), block_bytes=block)
    want = brute(rows)
    assert len(want) > 100 and rows_of(got) == want


def test_nulls_lengths_repeats_and_clashing_names(spark):
    r = random.Random(3)
    rows = close_rows(150, 8, 2)
    rows += [(200, None, 1), (300, [0.1] * 8, None), (None, [0.1] * 8, 1), (400, [0.1] * 7 + [None], 1), (500, [float("nan")] + [0.1] * 7, 1), (600, [float("inf")] + [0.1] * 7, 1)]
    rows += [(700, [0.5, 0.25], 1), (701, [0.5, 0.25], 1), (702, [0.5, 0.2], 2), (800, [], 1), (801, [], 1), (802, [], 2), rows[100], rows[100], rows[7], rows[7]]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "c", 1, 2.0) for x in rows], SCHEMA + ", id string, score int, `a.b` double")
    got = rows_of(hardneg.hard_negatives(df))
    assert got == brute(rows) and any(x[0] == 700 for x in got) and any(x[0] == 800 for x in got)


def test_large_components_and_empty(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(np.clip(r.normal(size=6) * 300_000 + 200_000, -1_000_000, 1_000_000))], i % 2) for i in range(120)] + [(900, [2.0**21] * 6, 0)]
    got = rows_of(hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows[:-1]) and got
    assert hardneg.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hardneg.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], SCHEMA)).count() == 0


def test_intervals_never_drop_a_pair_that_qualifies():
    r = np.random.default_rng(5)
    for _ in range(20):
        a, b = r.integers(-300, 300, (17, 9)), r.integers(-300, 300, (40, 9))
        exact = a @ b.T
        floor = np.quantile(exact, 0.9, axis=1)
        seen = []

        def may(at, low, high, exact=exact, floor=floor, seen=seen):
            seen.append(np.size(low))
            return high >= floor[at]

        i, j, s = hardneg.progressive(a, b, np.ones(exact.shape, bool), may)
        assert (exact[i, j] == s).all()
        assert set(zip(i, j, strict=True)) == set(zip(*np.nonzero(exact >= floor[:, None]), strict=True))
        assert min(seen) < max(seen)  # later planes see fewer pairs


def test_query_is_the_contract(spark, tmp_path):
    rows = close_rows(450, 16, 6)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    assert rows_of(queries.op11_hard_negatives(spark, str(tmp_path))) == brute(moved)
