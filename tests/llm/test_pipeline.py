import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_contamination import brute as hits_of
from tests.llm.test_neardup import brute as groups_of
from tests.llm.test_neardup import shingles
from tests.llm.test_quality_mixing_sharding import counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_rows():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    items = [" ".join(word() for _ in range(14)) for _ in range(4)]
    rows, n = [], 0
    for i in range(60):
        base = [word() for _ in range(r.randint(20, 160))]
        if i % 6 == 0:
            base[10:10] = items[i % 4].split()
        if i % 7 == 0:
            base = [w + "##" for w in base]
        for _ in range(1 + (i % 5 == 0) * 3):
            own = list(base)
            if r.random() < 0.6:
                own[r.randrange(len(own))] = word()
            rows.append((n, " ".join(own), "en", f"s{r.randint(0, 4)}", len(" ".join(own))))
            n += 1
    return rows + [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (0, *rows[0][1:])], items


def test_every_stage(spark, tmp_path):
    rows, items = fixture_rows()
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    bench = list(enumerate(items))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    steps = dict(corpus_pipeline.STAGES)

    one = [tuple(x) for x in steps["quality rules"](spark, docs, sf).collect()]

    def fine(text):
        w, chars, symbols, lines, repeat = counts(text)
        return not (w < 50 or 100 * repeat > 50 * w or 100 * symbols > 15 * w or chars > 25 * w or chars < 2 * w or (lines > 4 and 10 * lines > w) or 100 * repeat > 30 * w)

    assert sorted(one) == sorted(x for x in rows if fine(x[1])) and 0 < len(one) < len(rows)

    two = [tuple(x) for x in steps["MinHash near-dedup"](spark, spark.createDataFrame(one, DOCS), sf).collect()]
    import tests.llm.test_neardup as near

    old = near.shingles
    near.shingles = lambda t: shingles(t, 5)
    try:
        keep = {i for i, _, _, kept in groups_of([x[:2] for x in one]) if kept}
    finally:
        near.shingles = old
    assert sorted(two) == sorted({x for x in one if x[0] in keep}) and len(two) < len(one)

    three = [tuple(x) for x in steps["benchmark decontamination"](spark, spark.createDataFrame(two, DOCS), sf).collect()]
    assert len(three) == len(two)
    hit = {i: n for i, _, n, _ in hits_of([x[:2] for x in two], bench, 10)}
    before = {x[0]: x for x in two}
    assert any(hit.values())
    for x in three:
        assert (x == before[x[0]]) == (hit[x[0]] == 0) and x[4] == len(x[1])
        assert len(before[x[0]][1].split()) - len(x[1].split()) == hit[x[0]]
    assert not any(n for _, _, n, _ in hits_of([x[:2] for x in three], bench, 10))

    four = [tuple(x) for x in steps["mixing sources to target weights"](spark, spark.createDataFrame(three, DOCS), sf).collect()]
    assert set(four) <= set(three) and max(Counter(four).values()) <= 2

    five = steps["sharding"](spark, spark.createDataFrame(four, DOCS), sf)
    assert five.columns == [*docs.columns, "shard"]
    last = five.collect()
    assert sorted(tuple(x)[:5] for x in last) == sorted(four)
    per = Counter(x.shard for x in last)
    assert max(per.values()) - min(per.get(s, 0) for s in range(8)) <= 1

    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(*docs.columns).collect())) == sorted(four)
