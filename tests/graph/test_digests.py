import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.shared import shared_dir
from tessera.operators import diff, digests, search

NODE = "node_key string, kind string, display_name string"


def graph(spark, n, drop=(), change=()):
    nodes = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("node_key"), F.lit("function").alias("kind"), F.concat(F.lit("n"), "id").alias("display_name"))
    e = spark.range(n - 1).where(~F.col("id").isin(list(drop) or [-1])).select(F.sha2(F.col("id").cast("string"), 256).alias("src"), F.lit("calls").alias("relation"), F.sha2((F.col("id") + 1).cast("string"), 256).alias("dst"), F.lit("compiler").alias("origin"), F.when(F.col("id").isin(list(change) or [-1]), "likely").otherwise("certain").alias("confidence"), F.lit("resolved").alias("resolution"))
    return nodes, e.select(model.edge_key(F.col("src"), F.col("relation"), F.col("dst")).alias("edge_key"), "*")


def test_trees_follow_content(spark, monkeypatch):
    monkeypatch.setattr(digests, "LEAF", 4)
    r = random.Random(1)
    rows = [(f"{r.getrandbits(64):016x}", r.choice([None, "a", 'q"\n']), i) for i in range(300)]
    rows += [rows[0]] * 40
    df = spark.createDataFrame(rows, "k string, v string, n int")
    tree = lambda d: {x.prefix: (x.digest, x.n) for x in digests.digest_tree(d, "k").collect()}
    one = tree(df)
    assert one == tree(df.select("n", "v", "k").repartition(3)) and max(map(len, one)) == 2 and one[""][1] == 340
    other = [x if i != 7 else (x[0], x[1], -1) for i, x in enumerate(rows)]
    two = tree(spark.createDataFrame(other, "k string, v string, n int"))
    key = rows[7][0]
    assert {p for p in one if one[p] != two[p]} == {"", key[:1], key[:2]}
    assert tree(df.dropDuplicates()) != one and tree(df.limit(0)) == {}
    a, b = (digests.digest_tree(spark.createDataFrame(x, "k string, v string, n int"), "k") for x in (rows, other))
    assert [x.prefix for x in digests.changed_prefixes(a, b, 2).collect()] == [key[:2]]


def test_given_digits_hash_rows_whatever_their_number(spark, monkeypatch):
    monkeypatch.setattr(digests, "LEAF", 4)
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:9], "k string, v string").repartition(5)
    got = {x.prefix: (x.digest, x.n) for x in digests.digest_tree(df, "k", digits=1).collect()}
    lines = {}
    for i, (k, v) in enumerate(rows):
        own = hashlib.sha256(f'{{"k":"{k}","v":"{v}"}}'.encode()).hexdigest()
        lines.setdefault(k[0], []).append((f"{k} {own} {2 if i < 9 else 1}", 2 if i < 9 else 1))
    want = {p: (hashlib.sha256("\n".join(sorted(x for x, _ in own)).encode()).hexdigest(), sum(n for _, n in own)) for p, own in lines.items()}
    want[""] = hashlib.sha256("\n".join(want[p][0] for p in sorted(want)).encode()).hexdigest(), 3009
    assert got == want


class Coarse(digests.ContentStore):
    DIGITS = 1


def test_snapshots_are_known_by_content(spark):
    store = Coarse(spark, f"{shared_dir(spark)}/content-{uuid.uuid4().hex}")
    base = graph(spark, 300)
    one = store.publish_content(*base, None, workspace="w1")
    assert store.publish_content(base[0].repartition(3), base[1].select(*reversed(base[1].columns)).select(*base[1].columns), 1, workspace="w1") == one
    with pytest.raises(ValueError, match="other rows"):
        store.publish_content(*graph(spark, 300, change=[5]), 2, workspace="w1")
    head = graph(spark, 300, drop=[9], change=[5])
    two = store.publish_content(*head, 2, workspace="w2")
    assert two != one and store.changed("nodes", one, two) == [] and 1 <= len(store.changed("edges", one, two)) <= 2
    got = store.edge_changes(one, two)
    assert sorted(map(tuple, got.fillna("-").collect())) == sorted(map(tuple, diff.edge_diff(base[1], head[1]).fillna("-").collect()))
    assert 0 < store.rows("edges", one, store.changed("edges", one, two)).count() < 100
    assert store.node_changes(one, two, ["display_name"]).count() == 0
    b, h, rows = digests.working_tree_changes(store, base)
    assert (b, h) == (two, one) and sorted(r.change for r in rows.collect()) == ["added", "changed"]
    b, h, rows = digests.working_tree_changes(store, base)
    assert b == h == one and rows.count() == 0


def test_live_graph(spark):
    base, live = graph(spark, 20), graph(spark, 21, drop=[3], change=[4])
    got = sorted((r.part, r.change) for r in digests.graph_diff(base, live, ["display_name"]).collect())
    assert got == [("edge", "added"), ("edge", "changed"), ("edge", "removed"), ("node", "added")]


def test_folding(spark):
    words = ["Tiếng Việt", "ĐƯỜNG", "zażółć gęślą jaźń", "été", "İstanbul", "čšž", "ﬁn", "слово й", "ångström"]
    got = [x.w for x in spark.createDataFrame([(w,) for w in words], "t string").select(search.words_of(F.col("t")).alias("w")).collect()]
    assert got == [["tieng", "viet"], ["đuong"], ["zazołc", "gesla", "jazn"], ["ete"], ["istanbul"], ["csz"], ["ﬁn"], ["слово", "й"], ["angstrom"]]
    assert search.compile_query("Việ jaźń") == [["vie"], ["jazn"]]
