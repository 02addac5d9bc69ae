from pyspark.sql import functions as F

from tessera import model
from tessera.operators import digests
from tests.graph.test_plain import small


def test_content_by_names(spark, tmp_path):
    nodes, edges = small(spark)
    later = edges.where("relation = 'calls'").withColumn("origin", F.when(F.col("src_kind") == "method", "heuristic").otherwise(F.col("origin")))
    keyed = digests.ContentStore(spark, f"file://{tmp_path}/keyed")
    named = digests.NamedContentStore(spark, f"file://{tmp_path}/named")
    rows = lambda df: sorted(map(str, df.collect()))
    one, two = keyed.publish_content(nodes, model.with_edge_keys(edges), None), named.publish_content(nodes, edges, None)
    assert rows(keyed.tree(one, "edges")) == rows(named.tree(two, "edges"))
    assert set(spark.read.parquet(f"file://{tmp_path}/named/edges").columns) == {*edges.columns, "snapshot_id", "bucket"}  # no digest is written
    _, _, before = digests.working_tree_changes(keyed, (nodes, model.with_edge_keys(later)))
    _, _, after = digests.working_tree_changes(named, (nodes, later))
    assert before.columns == after.columns and before.count() == 2 and before.collect() == after.collect()
    assert named.publish_content(nodes, edges, 2) == two
