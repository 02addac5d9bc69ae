import random
import re

import numpy as np
import pytest

from tessera.llm import neardup

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(sets[k]), low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows))


def rows_of(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 14)):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = word()
            rows.append(" ".join(own) if r.random() < 0.8 else "\n".join(own).upper())
    rows += [None, "", " \t\n", "one", "one", "One", "one two", "two one", "a b c d", "a b c d e", "ONE\x0btwo"]
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 4096), (3, 4), (4, 6)])
def test_against_brute_force(spark, seed, block):
    rows = rows_of(seed)
    got = neardup.near_duplicates(spark.createDataFrame([(*x, "c") for x in rows], SCHEMA), block_docs=block).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_nulls_repeats_empty(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "only null ids"), (7, None)]
    got = neardup.near_duplicates(spark.createDataFrame([(*x, "c") for x in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 1, None, False), (7, 0, 7, True)], key=repr)
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_estimates_similarity():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 62, 300, dtype=np.uint64)
    y = x.copy()
    y[:60] = r.integers(0, 1 << 62, 60, dtype=np.uint64)
    flat = np.concatenate([np.unique(x), np.unique(y), x[:1]])
    s = neardup.superminhash(flat, np.array([0, 300, 600, 601]), 160)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.12
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert len(set((s[2] >> np.uint64(56)).tolist())) == 160  # one element fills one slot a round
