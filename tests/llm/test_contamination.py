import random
import re

import numpy as np
import pytest

from tessera.llm import contamination

DOCS = "doc_id long, text string, spans string, items string, row string, n_words int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)]


def brute(docs, items, width):
    out = []
    for i, text in docs:
        w = [x[0] for x in words(text)]
        hit, found = set(), set()
        for k, t in items:
            own = [x[0] for x in words(t)]
            n = min(width, len(own))
            for a in range(len(own) - n + 1 if own else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == own[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add("" if k is None else str(k))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def case(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "c", "Ab", "é9", "x" * 5]) + r.choice(["", "", ",", "!!"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12, 25])))) for i in range(9)]
    items += [(20, None), (21, ""), (22, items[3][1]), (None, "unusual null item words here")]
    docs = []
    for i in range(40):
        parts = [" ".join(f"w{r.randint(0, 50)}" for _ in range(r.randint(0, 10)))]
        for _ in range(r.randint(0, 3)):
            t = r.choice(items)[1] or ""
            a = r.randint(0, max(0, len(t) // 2))
            parts.append(t[a:].upper() if r.random() < 0.3 else t[a:])
            parts.append(" ".join(word() for _ in range(r.randint(0, 4))))
        docs.append((i, "; ".join(parts)))
    return docs + [(90, None), (91, ""), (92, "..."), (93, docs[5][1]), (93, docs[5][1]), (None, "unusual null item words here")], items


@pytest.mark.parametrize(("seed", "width", "part"), [(1, 4, 1 << 20), (2, 10, 1 << 20), (3, 3, 40), (4, 5, 100)])
def test_against_brute_force(spark, seed, width, part):
    docs, items = case(seed)
    df = spark.createDataFrame([(*x, "s", "i", "r", 1) for x in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.find_contamination(df, bench, width=width, part_bytes=part).collect()
    assert sorted([(x.row.doc_id, x.n_words, sum(s.end_word - s.first_word for s in x.spans), x["items"]) for x in got], key=repr) == brute(docs, items, width)
    for x in got:
        raw = (x.row.text or "").encode()
        own = words(x.row.text)
        for s in x.spans:
            assert words(raw[s.start : s.end].decode())[0][0] == own[s.first_word][0]
    clean = contamination.decontaminate(df, bench, width=width, part_bytes=part)
    assert clean.columns == df.columns
    for x in clean.collect():
        before = [d for d in docs if d[0] == x.doc_id][0][1]
        assert (x.text is None) == (before is None)
    untouched = {x.row.doc_id for x in got if not x.spans}
    assert all(x.text == [d for d in docs if d[0] == x.doc_id][0][1] for x in clean.collect() if x.doc_id in untouched)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination.decontaminate(df, bench).collect()[0].text == "a b c"
    assert contamination.find_contamination(df.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_index_ranks_and_order():
    r = np.random.default_rng(1)
    seq = np.concatenate([[0], r.integers(1, 6, 300), [0], r.integers(1, 6, 200), [0]])
    order = contamination.suffix_array(seq)
    marks = [tuple((0, i) if c == 0 else (1, c) for i, c in zip(range(k, len(seq)), seq[k:], strict=True)) for k in range(len(seq))]
    assert list(order) == sorted(range(len(seq)), key=lambda k: marks[k])
    index = contamination.FMIndex(seq, 5)
    patterns = r.integers(1, 6, (50, 3))
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi, strict=True):
        found = sorted(index.locate(np.arange(a, b)).tolist())
        assert found == [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
