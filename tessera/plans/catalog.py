"""The queries over the driver's tables, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model
from tessera.operators import aggregate as A
from tessera.operators import diff as D
from tessera.operators import intervals as I
from tessera.operators import project as P
from tessera.operators import review as R
from tessera.operators import reports as Q
from tessera.operators import search as S
from tessera.operators import store
from tessera.operators import textlines as X
from tessera.operators import traverse as G
from tessera.operators import views as V
from tessera.sources import captures as C
from tessera.sources import testdata as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
H = T.with_graph


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def graph(spark: SparkSession, sf: str, snapshot: str = T.HEAD, form: str = "keyed") -> tuple[DataFrame, DataFrame]:
    return T.published(spark, sf, snapshot, form)


def keyed(spark: SparkSession, *pairs: tuple[str, str]) -> DataFrame:
    """Node keys of (kind, qualified name) pairs, as `node`."""
    return spark.createDataFrame(list(pairs), "kind string, q string").select(model.node_key(F.col("kind"), F.col("q")).alias("node"))


def plain(spark: SparkSession, *pairs: tuple[str, str]) -> DataFrame:
    """As keyed, by plain keys."""
    return spark.createDataFrame(list(pairs), "kind string, q string").select(model.plain_key(F.col("kind"), F.col("q")).alias("node"))


def diffs_sql(body: str) -> str:
    return f"WITH b AS MATERIALIZED ({T.edges_sql(T.BASE)}), h AS MATERIALIZED ({T.edges_sql(T.HEAD)}), nb AS MATERIALIZED ({T.nodes_sql(T.BASE)}), nh AS MATERIALIZED ({T.nodes_sql(T.HEAD)}) {body}"


# snapshots and their checks

@query(T.nodes_sql())
def graph_nodes(spark, sf):
    return T.nodes(spark, sf)


@query(T.edges_sql())
def graph_edges(spark, sf):
    return T.edges(spark, sf)


@query(H(" SELECT edge_key, src, dst FROM edges WHERE relation = 'contains' AND (src NOT IN (SELECT node_key FROM nodes WHERE kind <> 'test') OR dst NOT IN (SELECT node_key FROM nodes WHERE kind <> 'test'))"))
def dangling_endpoints(spark, sf):
    """Against nodes without tests, so that there is something to find."""
    n, e = graph(spark, sf, form="plain")
    loose = model.dangling(e.where("relation = 'contains'"), n.where("kind <> 'test'"))
    ends = loose.select("relation", *[model.key_of_plain(F.col(c)).alias(c) for c in ("src", "dst")])
    return ends.select(model.edge_key(F.col("src"), F.col("relation"), F.col("dst")).alias("edge_key"), "src", "dst")


@query(f"SELECT relation, arg_max(origin, s) AS origin, arg_max(confidence, s) AS confidence, arg_max(resolution, s) AS resolution, count(*) AS n_claims, src, dst FROM (SELECT *, 100 * (list_position(['inferred', 'likely', 'certain'], confidence) - 1) + 10 * (list_position(['unresolved', 'partial', 'resolved'], resolution) - 1) + CASE origin WHEN 'compiler' THEN 5 ELSE 1 END AS s FROM ({T.claims_sql()})) GROUP BY src, relation, dst")
def strongest_claim(spark, sf):
    return model.with_edge_keys(T.named_claims(spark, sf)).drop("edge_key")


@query("SELECT user_id, sha256(string_agg(path || chr(0) || h, chr(10) ORDER BY path || chr(0) || h)) AS workspace_hash, count(*) AS n_files FROM (SELECT user_id, CAST(event_id AS VARCHAR) AS path, sha256(props) AS h FROM events) GROUP BY user_id")
def workspace_hash(spark, sf):
    files = T.table(spark, sf, "events").select("user_id", F.col("event_id").cast("string").alias("path"), F.sha2("props", 256).alias("hash"))
    return store.workspace_hash(files, ["user_id"])


@query("WITH e AS (SELECT *, user_id * 100 + CAST(props->>'$.k' AS BIGINT) AS snap FROM events) SELECT user_id, max(event_id) AS activation_id, arg_max(snap, event_id) AS snapshot_id FROM e WHERE snap NOT IN (SELECT snap FROM e WHERE event_type = 'error' AND value > 40) GROUP BY user_id")
def snapshot_head(spark, sf):
    """Events as activations of a task's snapshot k; snapshots with a costly error are broken."""
    e = T.table(spark, sf, "events").withColumn("snapshot_id", F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long")).withColumnRenamed("event_id", "activation_id")
    return store.newest_valid(e.select("user_id", "activation_id", "snapshot_id"), e.where("event_type = 'error' AND value > 40"), ["user_id"])


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
def gc_orphans(spark, sf):
    line = T.table(spark, sf, "lineitem")
    return store.orphans(T.table(spark, sf, "part").select("p_partkey"), "p_partkey", line.where("l_quantity > 48").select("l_partkey"), line.where("l_quantity < 3").select("l_partkey"))


@query("SELECT event_id, ts FROM events WHERE NOT (ts < TIMESTAMP '2024-01-15' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90))")
def retention(spark, sf):
    e = T.table(spark, sf, "events").withColumnRenamed("user_id", "task")
    done = e.where("event_type = 'purchase' AND value > 90").select("task").distinct()
    return store.retained(e, done, "2024-01-15 00:00:00").select("event_id", "ts")


@query("SELECT path, CASE WHEN l IS NULL THEN 'stale' WHEN s IS NULL THEN 'unknown' WHEN l = s THEN 'fresh' ELSE 'stale' END AS freshness FROM (SELECT coalesce(a.path, b.path) AS path, a.h AS s, b.h AS l FROM (SELECT 'd/' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT 'd/' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) b ON a.path = b.path)")
def freshness(spark, sf):
    d = T.table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id")).alias("path"), "doc_id", "text")
    live = d.where("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return store.freshness(d.where("doc_id % 5 <> 0").select("path", F.sha2("text", 256).alias("hash")), live)


# aggregates

@query(H(" SELECT r AS relation, CAST(count(edge_key) AS BIGINT) AS n_edges FROM (SELECT unnest(['contains', 'imports', 'exports', 'references', 'calls', 'implements', 'extends', 'tests', 'routes_to', 'documents', 'changed_with']) AS r) LEFT JOIN edges ON relation = r GROUP BY r"))
def relation_histogram(spark, sf):
    return A.relation_histogram(graph(spark, sf)[1])


@query(H(""", pk AS (SELECT node_key AS pkg, display_name AS package_name FROM nodes WHERE kind = 'package'),
f AS (SELECT DISTINCT pkg, file FROM pk JOIN edges ON src = pkg AND relation = 'contains' JOIN nodes ON node_key = dst WHERE file IS NOT NULL UNION SELECT pkg, file FROM pk JOIN nodes ON package = package_name WHERE kind = 'file')
SELECT pkg AS node_key, package_name, CAST(count(DISTINCT f.file) AS BIGINT) AS n_files, CAST(count(n.node_key) AS BIGINT) AS n_symbols FROM pk LEFT JOIN f USING (pkg) LEFT JOIN nodes n ON n.file = f.file AND n.kind <> 'file' GROUP BY ALL"""))
def package_rollup(spark, sf):
    return A.package_rollup(*graph(spark, sf))


#: One end after the other: in one FROM clause the inequality would be planned first.
_ENDS = ", e1 AS MATERIALIZED (SELECT edges.*, a.package AS ap, a.file AS af FROM edges JOIN nodes a ON src = a.node_key), ends AS MATERIALIZED (SELECT e1.*, b.package AS bp, b.file AS bf FROM e1 JOIN nodes b ON dst = b.node_key)"


@query(H(_ENDS + " SELECT ap AS src_package, bp AS dst_package, count(*) AS n_imports FROM ends WHERE relation = 'imports' AND ap <> bp GROUP BY ALL ORDER BY 1, 2 LIMIT 50"))
def package_dependencies(spark, sf):
    return A.package_dependencies(*graph(spark, sf, form="plain"))


@query(H(" SELECT split_part(file, '/', 1) AS directory, count(*) AS n_files FROM nodes WHERE kind = 'file' GROUP BY 1"))
def directory_counts(spark, sf):
    return A.directory_counts(graph(spark, sf)[0])


@query(H(" SELECT language, count(*) AS n_files, count(*) FILTER (ends_with(file, '0')) AS n_generated, CASE WHEN bool_or(ends_with(file, '1')) THEN 'inventory,' ELSE '' END || CASE WHEN bool_or(NOT ends_with(file, '1')) THEN 'semantic' ELSE '' END AS capabilities FROM nodes WHERE kind = 'file' GROUP BY 1"))
def language_stats(spark, sf):
    return A.language_stats(graph(spark, sf)[0], F.endswith("file", F.lit("0")), F.when(F.endswith("file", F.lit("1")), "inventory").otherwise("semantic"))


@query("SELECT count(*) FILTER (s = 'info') AS n_info, count(*) FILTER (s = 'warning') AS n_warning, count(*) FILTER (s = 'error') AS n_error FROM (SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS s FROM events)")
def severity_histogram(spark, sf):
    return A.severity_histogram(T.table(spark, sf, "events").select(F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END").alias("severity")))


@query(H(" SELECT dst AS node_key, display_name, count(*) AS fan_in FROM edges JOIN nodes ON node_key = dst WHERE relation IN ('imports', 'references', 'calls', 'implements', 'extends', 'routes_to') GROUP BY 1, 2 ORDER BY 3 DESC, 2, 1 LIMIT 8"))
def fan_in_topk(spark, sf):
    n, e = graph(spark, sf, form="plain")
    return A.hotspots(n, e, key=model.key_of_plain)


@query(H(" SELECT relation, origin, confidence, resolution, count(*) AS n_edges FROM edges GROUP BY ALL"))
def provenance_buckets(spark, sf):
    return A.provenance_buckets(graph(spark, sf)[1])


@query("SELECT p_brand AS id, CAST(p_size % 5 AS VARCHAR) AS version, CASE max(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END) WHEN 0 THEN 'inventory' WHEN 1 THEN 'structural' ELSE 'semantic' END AS capability, string_agg(DISTINCT split_part(p_name, ' ', 2), ',' ORDER BY split_part(p_name, ' ', 2)) AS languages FROM part GROUP BY 1, 2")
def extractor_inventory(spark, sf):
    rows = T.table(spark, sf, "part").select(F.col("p_brand").alias("id"), (F.col("p_size") % 5).cast("string").alias("version"), F.expr("CASE p_type WHEN 'ECONOMY' THEN 'inventory' WHEN 'STANDARD' THEN 'structural' ELSE 'semantic' END").alias("capability"), F.split("p_name", " ")[1].alias("language"))
    return A.extractor_inventory(rows)


@query("SELECT event_type, arg_max(value, k) AS value, max(n) AS n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE k <= ceil(n * 0.95) GROUP BY 1")
def p95_latency(spark, sf):
    return A.nearest_rank(T.table(spark, sf, "events"), ["event_type"], "value", 0.95)


@query("SELECT user_id, count(*) AS n_runs, round(avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 6) AS success_rate, CASE WHEN count(*) FILTER (k = 13) > 0 THEN NULL ELSE CAST(CAST(sum(k) AS BIGINT) AS VARCHAR) END AS tokens, round(avg(value), 6) AS mean_wall_ms FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY user_id")
def suite_summary(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    runs = T.table(spark, sf, "events").select("user_id", (F.col("event_type") != "error").alias("success"), F.when(k != 13, k).alias("tokens"), F.col("value").alias("wall_ms"))
    return A.suite_summary(runs, ["user_id"]).withColumn("tokens", F.col("tokens").cast("string"))


@query(H(", h AS (SELECT sha256(edge_key || chr(1) || origin || chr(1) || confidence) AS h FROM edges), b AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n_rows FROM b"))
def graph_digest(spark, sf):
    return A.set_digest(graph(spark, sf)[1], ["edge_key", "origin", "confidence"])


@query("WITH s AS (SELECT p_brand AS kind, p_type AS reason, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, kind, reason) AS k, count(*) OVER () AS c FROM s) SELECT CASE WHEN c > 20 AND k > 19 THEN 'other' ELSE kind END AS kind, CASE WHEN c > 20 AND k > 19 THEN 'other' ELSE reason END AS reason, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2")
def omission_fold(spark, sf):
    return A.omission_fold(T.table(spark, sf, "part").select(F.col("p_brand").alias("kind"), F.col("p_type").alias("reason"), F.lit(1).alias("n")), ["kind", "reason"])


# diffs

@query(diffs_sql("SELECT edge_key, 'added' AS change, src, relation, dst, NULL AS before_origin, NULL AS before_confidence, NULL AS before_resolution, origin AS after_origin, confidence AS after_confidence, resolution AS after_resolution FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.edge_key = h.edge_key) UNION ALL SELECT edge_key, 'removed', src, relation, dst, origin, confidence, resolution, NULL, NULL, NULL FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE b.edge_key = h.edge_key) UNION ALL SELECT b.edge_key, 'changed', b.src, b.relation, b.dst, b.origin, b.confidence, b.resolution, h.origin, h.confidence, h.resolution FROM b JOIN h ON b.edge_key = h.edge_key WHERE (b.origin, b.confidence, b.resolution) IS DISTINCT FROM (h.origin, h.confidence, h.resolution)"))
def edge_diff(spark, sf):
    return D.named_edge_diff(graph(spark, sf, T.BASE, "named")[1], graph(spark, sf, form="named")[1])


@query(diffs_sql("SELECT node_key, 'added' AS change FROM nh WHERE node_key NOT IN (SELECT node_key FROM nb) UNION ALL SELECT node_key, 'removed' FROM nb WHERE node_key NOT IN (SELECT node_key FROM nh)"))
def node_diff(spark, sf):
    diff = D.key_diff(graph(spark, sf, T.BASE, "plain")[0], graph(spark, sf, form="plain")[0], "node_key", ["display_name"])
    return diff.withColumn("node_key", model.key_of_plain(F.col("node_key")))


_SUPPLIER = "SELECT CAST(s_suppkey AS VARCHAR) AS project, {0} AS bal FROM supplier WHERE s_suppkey % {1} <> 0"


@query(f"SELECT coalesce(a.project, b.project) AS project, CASE WHEN a.project IS NULL THEN 'added' WHEN b.project IS NULL THEN 'removed' ELSE 'metadata_changed' END AS change FROM ({_SUPPLIER.format('s_acctbal', 4)}) a FULL JOIN ({_SUPPLIER.format('CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal ELSE NULL END', 3)}) b ON a.project = b.project WHERE a.project IS NULL OR b.project IS NULL OR a.bal IS DISTINCT FROM b.bal")
def project_diff(spark, sf):
    s = T.table(spark, sf, "supplier").withColumn("project", F.col("s_suppkey").cast("string"))
    return D.key_diff(s.where("s_suppkey % 4 <> 0").withColumn("bal", F.col("s_acctbal")), s.where("s_suppkey % 3 <> 0").withColumn("bal", F.expr("CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal END")), "project", ["bal"])


@query("SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'metadata_changed' END AS change FROM (SELECT 'p/' || page_id AS k, sha256(html) AS h FROM pages WHERE page_id % 6 <> 0) a FULL JOIN (SELECT 'p/' || page_id AS k, sha256(CASE WHEN page_id % 5 = 0 THEN '' ELSE html END) AS h FROM pages WHERE page_id % 7 <> 0) b ON a.k = b.k WHERE a.h IS DISTINCT FROM b.h")
def manifest_diff(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id", F.concat(F.lit("p/"), F.col("page_id")).alias("path"), "html")
    return D.key_diff(p.where("page_id % 6 <> 0").select("path", F.sha2("html", 256).alias("h")), p.where("page_id % 7 <> 0").select("path", F.sha2(F.expr("CASE WHEN page_id % 5 = 0 THEN '' ELSE html END"), 256).alias("h")), "path", ["h"])


def renamed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents: even ids are removed, odd ids added; some added ones bear another name. Some are classes, the others functions; the language names the extractor."""
    name = F.when((F.col("doc_id") % 4 == 1), F.concat("lang", F.lit("2"))).otherwise(F.col("lang"))
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), model.body_hash(F.col("text")).alias("body"), name.alias("name"), F.when(F.col("doc_id") % 10 == 3, "class").otherwise("function").alias("kind"), F.lit("1").alias("analyzer"), F.col("lang").alias("extractor"), (F.length("lang") % 2).cast("string").alias("extractor_version"))
    return d.where("id % 2 = 0"), d.where("id % 2 = 1")


RENAMED_SQL = r"""WITH d AS (SELECT doc_id AS id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body, CASE WHEN doc_id % 4 = 1 THEN lang || '2' ELSE lang END AS name, CASE WHEN doc_id % 10 = 3 THEN 'class' ELSE 'function' END AS kind, lang AS extractor FROM documents),
r AS (SELECT *, count(*) OVER (PARTITION BY body, kind, extractor, name) AS c FROM d WHERE id % 2 = 0), a AS (SELECT *, count(*) OVER (PARTITION BY body, kind, extractor, name) AS c FROM d WHERE id % 2 = 1),
pa AS (SELECT r.id AS removed_id, a.id AS added_id FROM r JOIN a ON r.body = a.body AND r.kind = a.kind AND r.extractor = a.extractor AND r.name = a.name WHERE r.c = 1 AND a.c = 1),
r2 AS (SELECT *, count(*) OVER (PARTITION BY body, kind, extractor) AS c2 FROM r WHERE id NOT IN (SELECT removed_id FROM pa)), a2 AS (SELECT *, count(*) OVER (PARTITION BY body, kind, extractor) AS c2 FROM a WHERE id NOT IN (SELECT added_id FROM pa))"""


@query(RENAMED_SQL + " SELECT * FROM pa")
def rename_stage_a(spark, sf):
    return D.unique_pairs(*renamed(spark, sf), [*D.NODE_KEY, "name"])


@query(RENAMED_SQL + " SELECT r2.id AS removed_id, a2.id AS added_id FROM r2 JOIN a2 ON r2.body = a2.body AND r2.kind = a2.kind AND r2.extractor = a2.extractor WHERE r2.c2 = 1 AND a2.c2 = 1")
def rename_stage_b(spark, sf):
    return D.unique_pairs(*D.residual(*renamed(spark, sf), "name", D.NODE_KEY), D.NODE_KEY)


@query(RENAMED_SQL + " SELECT body, kind, extractor, (SELECT count(*) FROM r2 x WHERE (x.body, x.kind, x.extractor) = (k.body, k.kind, k.extractor)) AS removed_n, (SELECT count(*) FROM a2 x WHERE (x.body, x.kind, x.extractor) = (k.body, k.kind, k.extractor)) AS added_n FROM (SELECT body, kind, extractor FROM r2 INTERSECT SELECT body, kind, extractor FROM a2) k WHERE removed_n > 1 OR added_n > 1")
def ambiguous_groups(spark, sf):
    return D.ambiguous_groups(*D.residual(*renamed(spark, sf), "name", D.NODE_KEY), D.NODE_KEY).drop("analyzer", "extractor_version")


@query("""WITH r AS (SELECT 'r' || l_orderkey || '-' || l_linenumber AS k, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 2 = 0),
a AS (SELECT 'a' || l_orderkey || '-' || l_linenumber AS k, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_linenumber = 2 AND l_orderkey % 2 = 1),
r2 AS (SELECT k, 'o' || (CAST(substr(src, 2) AS BIGINT) + 1) AS src, CASE WHEN CAST(substr(dst, 2) AS BIGINT) % 3 = 0 THEN 'p7' ELSE dst END AS dst FROM r),
r3 AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY k) AS n FROM r2), a3 AS (SELECT *, row_number() OVER (PARTITION BY src, CASE WHEN CAST(substr(dst, 2) AS BIGINT) % 50 = 0 THEN 'p7' ELSE dst END ORDER BY k) AS n, CASE WHEN CAST(substr(dst, 2) AS BIGINT) % 50 = 0 THEN 'p7' ELSE dst END AS d FROM a)
SELECT r3.k AS removed_edge, a3.k AS added_edge FROM r3 JOIN a3 ON r3.src = a3.src AND r3.dst = a3.d AND r3.n = a3.n""")
def edge_coalesce(spark, sf):
    """Orders 2n were renamed to 2n + 1, parts divisible by 3 to part 7; added edges' parts divisible by 50 are part 7."""
    line = T.table(spark, sf, "lineitem")
    edge = lambda df, mark, dst: df.select(F.concat(F.lit(mark), "l_orderkey", F.lit("-"), "l_linenumber").alias("edge_key"), F.concat(F.lit("o"), "l_orderkey").alias("src"), F.lit("calls").alias("relation"), dst.alias("dst"))
    part = F.concat(F.lit("p"), "l_partkey")
    removed = edge(line.where("l_linenumber = 1 AND l_orderkey % 2 = 0"), "r", part)
    added = edge(line.where("l_linenumber = 2 AND l_orderkey % 2 = 1"), "a", F.when(F.col("l_partkey") % 50 == 0, "p7").otherwise(part))
    orders = T.table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("removed_id"), F.concat(F.lit("o"), (F.col("o_orderkey") + 1).cast("string")).alias("added_id"))
    parts = T.table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("removed_id"), F.lit("p7").alias("added_id"))
    return D.coalesce_edges(removed, added, orders.union(parts))


@query("""WITH r AS (SELECT 'r' || l_orderkey || '-' || l_linenumber AS k, 'o' || (l_orderkey + 1) AS src, CASE WHEN l_partkey % 3 = 0 THEN 'p7' ELSE 'p' || l_partkey END AS dst FROM lineitem WHERE l_orderkey % 2 = 0),
a AS (SELECT 'a' || l_orderkey || '-' || l_linenumber AS k, 'o' || l_orderkey AS src, CASE WHEN l_partkey % 50 = 0 THEN 'p7' ELSE 'p' || l_partkey END AS dst FROM lineitem WHERE l_orderkey % 2 = 1),
rn AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY k) AS n FROM r), an AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY k) AS n FROM a)
SELECT rn.k AS removed_edge, an.k AS added_edge FROM rn JOIN an USING (src, dst, n)""")
def edge_coalesce_lines(spark, sf):
    """The scenario of edge_coalesce over all line items: lines of even orders are the removed edges, lines of odd orders the added ones."""
    line = T.table(spark, sf, "lineitem")
    part = F.concat(F.lit("p"), "l_partkey")
    edge = lambda df, mark, dst: df.select(F.concat(F.lit(mark), "l_orderkey", F.lit("-"), "l_linenumber").alias("edge_key"), F.concat(F.lit("o"), "l_orderkey").alias("src"), F.lit("calls").alias("relation"), dst.alias("dst"))
    even = F.col("l_orderkey") % 2 == 0
    orders = T.table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("removed_id"), F.concat(F.lit("o"), (F.col("o_orderkey") + 1).cast("string")).alias("added_id"))
    parts = T.table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("removed_id"), F.lit("p7").alias("added_id"))
    return D.coalesce_edges(edge(line.where(even), "r", part), edge(line.where(~even), "a", F.when(F.col("l_partkey") % 50 == 0, "p7").otherwise(part)), orders.union(parts))


@query(diffs_sql("SELECT part, key FROM (SELECT 0 AS o, 'addedNodes' AS part, node_key AS key FROM nh WHERE node_key NOT IN (SELECT node_key FROM nb) UNION ALL SELECT 1, 'removedNodes', node_key FROM nb WHERE node_key NOT IN (SELECT node_key FROM nh) UNION ALL SELECT 2, 'edges', edge_key FROM h WHERE edge_key NOT IN (SELECT edge_key FROM b)) ORDER BY o, key LIMIT 500 OFFSET 100"))
def review_page(spark, sf):
    """The second page of a review: a limit is its feature."""
    nb, nh = graph(spark, sf, T.BASE)[0], graph(spark, sf)[0]
    new = graph(spark, sf)[1].join(graph(spark, sf, T.BASE)[1].select("edge_key"), "edge_key", "left_anti")
    return D.paged([("addedNodes", nh.join(nb.select("node_key"), "node_key", "left_anti").select(F.col("node_key").alias("k"))), ("removedNodes", nb.join(nh.select("node_key"), "node_key", "left_anti").select(F.col("node_key").alias("k"))), ("edges", new.select(F.col("edge_key").alias("k")))], "k", 100, 500)


# search

_W = "list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT p_partkey, p_name, {_W} AS w FROM part), h AS (SELECT *, len(w) AS len, len(list_filter(w, lambda x: starts_with(x, 're'))) AS f0, len(list_filter(w, lambda x: starts_with(x, 'wi'))) AS f1 FROM w),
t AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM h)
SELECT p_partkey, p_name = 're wi' AS exact, round(greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / mean)) + greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score,
 (SELECT count(*) FROM h WHERE f0 > 0 AND f1 > 0) AS n_hits FROM h, t WHERE f0 > 0 AND f1 > 0 ORDER BY exact DESC, score DESC, p_partkey LIMIT 50""")
def symbol_search(spark, sf):
    return S.search(T.table(spark, sf, "part"), "re wi", "p_partkey", ["p_name"], limit=50)


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, len(w) AS len, len(list_filter(range(1, len(w) - 1 + 1), lambda i: w[i] = 'of' AND starts_with(w[i + 1], 'th'))) AS f FROM w),
t AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f > 0) AS n0 FROM h)
SELECT doc_id, round(greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM h, t WHERE f > 0""")
def search_bm25(spark, sf):
    """All hits of the phrase `of_th`, whose last word is a prefix."""
    d = T.table(spark, sf, "documents").select("doc_id", S.words_of(F.col("text")).alias("words"))
    return S.bm25(d, S.compile_query("of_th"), "doc_id")


# walks

ROOTS = tuple(("function", f"part:{i}") for i in range(1, 6)) + (("file", "s/3"),)
_ROOTS = "(VALUES " + ", ".join(f"(sha256('node|{k}|{q}'))" for k, q in ROOTS) + ")"
_IMPACT = f", r AS (SELECT v AS node FROM {_ROOTS} t(v)), w AS (SELECT node, 0 AS hop FROM r UNION SELECT src, hop + 1 FROM w JOIN edges ON dst = node WHERE relation IN ('calls', 'imports') AND hop < 3), reached AS (SELECT node, min(hop) AS hop FROM w GROUP BY node)"


@query(H(_IMPACT + " SELECT * FROM reached", recursive=True))
def impact_hops(spark, sf):
    return G.impact(graph(spark, sf)[1], keyed(spark, *ROOTS), 3)


@query(H(_IMPACT + " SELECT t AS test, count(DISTINCT o) AS n_covered FROM (SELECT src AS t, dst AS o FROM edges WHERE relation = 'tests' UNION SELECT dst, src FROM edges WHERE relation = 'tests') JOIN reached ON o = node JOIN nodes ON t = node_key WHERE kind = 'test' GROUP BY 1", recursive=True))
def impact_tests(spark, sf):
    n, e = graph(spark, sf)
    return G.impact_tests(e, G.impact(e, keyed(spark, *ROOTS), 3), n)


@query(H(f" SELECT coalesce(package, '(unassigned)') AS package, count(DISTINCT src) AS n_beyond FROM edges JOIN nodes ON node_key = src WHERE relation IN ('calls', 'imports') AND dst IN (SELECT v FROM {_ROOTS} t(v)) GROUP BY 1"))
def impact_beyond_depth(spark, sf):
    n, e = graph(spark, sf)
    return G.beyond_depth(e, G.impact(e, keyed(spark, *ROOTS), 0), n, 0)


ANCHOR = ("function", "part:1")
_CONTEXT = """, a AS (SELECT sha256('node|function|part:1') AS node), u AS (SELECT src, dst, relation, origin, confidence, resolution FROM edges WHERE relation IN ('calls', 'imports', 'tests') UNION ALL SELECT dst, src, relation, origin, confidence, resolution FROM edges WHERE relation IN ('calls', 'imports', 'tests')),
l1 AS (SELECT DISTINCT dst AS node FROM u JOIN a ON src = a.node WHERE dst <> a.node), l2 AS (SELECT DISTINCT dst AS node FROM u JOIN l1 ON src = l1.node WHERE dst NOT IN (SELECT node FROM l1) AND dst NOT IN (SELECT node FROM a)),
seen AS (SELECT node, 0 AS hop FROM a UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2),
c AS (SELECT x.node, x.hop, max(CASE confidence WHEN 'certain' THEN 2 WHEN 'likely' THEN 1 ELSE 0 END) AS cr,
 max(CASE WHEN x.hop = 1 AND relation = 'calls' THEN CASE WHEN origin = 'compiler' AND confidence = 'certain' AND resolution = 'resolved' THEN 2 ELSE 1 END ELSE 0 END) AS cp,
 max(CASE WHEN x.hop = 1 AND relation = 'tests' THEN CASE WHEN confidence = 'certain' THEN 2 ELSE 1 END ELSE 0 END) AS tl FROM u JOIN seen x ON u.src = x.node JOIN seen y ON u.dst = y.node AND y.hop + 1 = x.hop GROUP BY ALL),
f AS (SELECT dst, count(*) AS fan_in FROM edges WHERE relation IN ('imports', 'references', 'calls', 'implements', 'extends', 'routes_to') GROUP BY 1),
ranked AS (SELECT c.node, hop, greatest(cp, CASE WHEN kind = 'test' AND tl = 2 THEN 2 ELSE 0 END) AS priority, coalesce(fan_in, 0) AS fan_in, cr AS confidence_rank,
 round(2.5 / (1 + hop) + ln(1 + coalesce(fan_in, 0)) + 1.5 * CASE WHEN tl > 0 THEN 1 ELSE 0 END + 0.5 * CASE WHEN package = (SELECT package FROM nodes JOIN a ON node_key = a.node) THEN 1 ELSE 0 END, 6) AS score
 FROM c JOIN nodes ON node_key = c.node LEFT JOIN f ON f.dst = c.node)"""


@query(H(_CONTEXT + " SELECT * FROM ranked"))
def context_rank(spark, sf):
    return _context(spark, sf)


def _context(spark, sf) -> DataFrame:
    """The walk goes by plain keys; what it found has its keys made at the end."""
    n, e = graph(spark, sf, form="plain")
    return G.context(e, n, plain(spark, ANCHOR)).withColumn("node", model.key_of_plain(F.col("node")))


@query(H(_CONTEXT + " SELECT node, score, running FROM (SELECT node, score, CAST(sum(cost) OVER (ORDER BY priority DESC, score DESC, confidence_rank DESC, node ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT *, CAST(ceil(length(qualified_name) / 4.0) AS BIGINT) AS cost FROM ranked JOIN nodes ON node_key = node)) WHERE running <= 300"))
def context_budget(spark, sf):
    n = graph(spark, sf)[0]
    ranked = _context(spark, sf).join(n.select(F.col("node_key").alias("node"), "qualified_name"), "node")
    order = [F.desc("priority"), F.desc("score"), F.desc("confidence_rank"), F.asc("node")]
    return G.within_budget(ranked, order, F.ceil(F.length("qualified_name") / 4).cast("long"), 300).select("node", "score", "running")


def a_nation(spark, sf, key=model.node_key) -> DataFrame:
    return T.table(spark, sf, "nation").where("n_nationkey = 3").select(key(F.lit("package"), F.concat(F.lit("nation:"), "n_name")).alias("node"))


@query(H(" SELECT row_number() OVER (ORDER BY a.edge_key, b.edge_key, c.edge_key) AS rank, 3 AS n_edges, a.edge_key || ',' || b.edge_key || ',' || c.edge_key AS edge_keys, 'ok' AS status FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.relation = 'contains' AND b.relation = 'contains' AND c.relation = 'calls' AND a.src = (SELECT sha256('node|package|nation:' || n_name) FROM nation WHERE n_nationkey = 3) AND c.dst IN (SELECT sha256('node|function|part:' || p_partkey) FROM part WHERE p_partkey < 20) ORDER BY 1 LIMIT 3"))
def k_paths(spark, sf):
    """All paths: no number of grown paths limits the search."""
    target = plain(spark, *[("function", f"part:{i}") for i in range(20)])
    out = G.k_paths(graph(spark, sf, form="plain")[1], a_nation(spark, sf, model.plain_key), target, 3, most_rows=None, relations=("contains", "calls", "imports"), key=model.edge_key_of_plain())
    return out.select(F.col("rank").cast("long").alias("rank"), "n_edges", F.array_join("edge_keys", ",").alias("edge_keys"), "status")


@query(H(""", s AS (SELECT sha256('node|package|nation:' || n_name) AS node FROM nation WHERE n_nationkey = 3), t AS (SELECT sha256('node|function|part:1') AS node),
o AS (SELECT node, 0 AS d FROM s UNION SELECT dst, d + 1 FROM o JOIN edges ON src = node WHERE relation IN ('contains', 'calls', 'imports') AND d < 2), o2 AS (SELECT node, min(d) AS from_source FROM o GROUP BY 1),
b AS (SELECT node, 0 AS d FROM t UNION SELECT src, d + 1 FROM b JOIN edges ON dst = node WHERE relation IN ('contains', 'calls', 'imports')), b2 AS (SELECT node, min(d) AS to_target FROM b GROUP BY 1)
SELECT node, from_source, to_target FROM o2 LEFT JOIN b2 USING (node) ORDER BY to_target NULLS LAST, from_source DESC, node LIMIT 5""", recursive=True))
def nearest_approach(spark, sf):
    """The search is limited to two edges; the graph has levels, so all ways to a node are equally long."""
    return G.nearest_approach(graph(spark, sf)[1], a_nation(spark, sf), keyed(spark, ANCHOR), 2, relations=("contains", "calls", "imports"))


@query(H(f" SELECT dst AS node, src AS test, CASE origin WHEN 'compiler' THEN 'static' ELSE 'naming' END AS linkage, confidence FROM edges JOIN nodes ON node_key = src WHERE relation = 'tests' AND kind = 'test' AND dst IN (SELECT v FROM {_ROOTS} t(v))"))
def find_tests(spark, sf):
    n, e = graph(spark, sf)
    return G.find_tests(e, n, keyed(spark, *ROOTS))


@query(H(""", e AS (SELECT * FROM edges WHERE relation IN ('contains', 'calls')), w AS (SELECT sha256('node|file|c/7') AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM w JOIN e ON src = node WHERE resolution <> 'unresolved' AND hop < 8), seen AS (SELECT node, min(hop) AS hop FROM w GROUP BY 1), t AS (SELECT DISTINCT dst FROM edges WHERE relation = 'tests')
SELECT hop, src, edge_key, relation, e.dst, CASE WHEN resolution = 'unresolved' THEN 'unresolved' WHEN origin = 'heuristic' AND resolution = 'partial' THEN 'ambiguous' WHEN confidence = 'inferred' THEN 'inferred' WHEN t.dst IS NOT NULL THEN 'test-backed' WHEN origin = 'compiler' AND resolution = 'resolved' THEN 'statically-resolved' ELSE 'inferred' END AS label FROM e JOIN seen ON src = node LEFT JOIN t ON t.dst = e.dst""", recursive=True))
def route_story(spark, sf):
    return G.story(graph(spark, sf)[1], keyed(spark, ("file", "c/7")), relations=("contains", "calls")).select("hop", "src", "edge_key", "relation", "dst", "label")


@query("WITH RECURSIVE i AS (SELECT DISTINCT 'c/' || o_custkey AS src, 's/' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT 's/' || s_suppkey, 'n/' || s_nationkey FROM supplier), w AS (SELECT 'n/3' AS node UNION SELECT src FROM w JOIN i ON dst = node) SELECT node FROM w")
def import_closure(spark, sf):
    """Files that import nation 3's file, whatever the number of steps."""
    line = T.table(spark, sf, "lineitem").join(T.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    links = line.select(F.concat(F.lit("c/"), "o_custkey").alias("dst"), F.concat(F.lit("s/"), "l_suppkey").alias("src")).distinct().union(T.table(spark, sf, "supplier").select(F.concat(F.lit("s/"), "s_suppkey"), F.concat(F.lit("n/"), "s_nationkey")))
    return G.reach(spark.createDataFrame([("n/3",)], "node string"), links).select("node")


# projections

_OWNER = ", p AS (SELECT node_key AS root, node_key AS node, 0 AS hop FROM nodes WHERE kind = 'package' UNION SELECT root, dst, hop + 1 FROM p JOIN edges ON src = node WHERE relation = 'contains'), m AS (SELECT node, min(hop) AS distance FROM p GROUP BY 1), o AS (SELECT p.node, min(root) AS root, count(*) AS n, distance FROM p JOIN m ON p.node = m.node AND hop = distance GROUP BY p.node, distance), owners AS (SELECT node_key, CASE WHEN n = 1 THEN root END AS owner, distance, CASE WHEN n IS NULL THEN 'unowned' WHEN n > 1 THEN 'ambiguous' ELSE 'owned' END AS status FROM nodes LEFT JOIN o ON node = node_key)"


@query(H(_OWNER + " SELECT node_key, owner, coalesce(distance, -1) AS distance, status FROM owners", recursive=True))
def ownership(spark, sf):
    return P.ownership(*graph(spark, sf)).na.fill(-1, ["distance"])


@query(H(_OWNER + " SELECT a.owner AS src_package, b.owner AS dst_package, relation, count(*) AS n_edges, min(edge_key) AS first_edge, sha256('package-edge|' || a.owner || '|' || relation || '|' || b.owner) AS group_key FROM edges JOIN owners a ON src = a.node_key JOIN owners b ON dst = b.node_key WHERE a.owner <> b.owner GROUP BY 1, 2, 3", recursive=True))
def package_edges(spark, sf):
    n, e = graph(spark, sf)
    return P.package_edges(e, P.ownership(n, e))


@query(H(_OWNER + " SELECT count(*) AS n_candidates, count(*) FILTER (a.owner <> b.owner) AS n_projected, count(*) - count(*) FILTER (a.owner <> b.owner) AS n_omitted, (SELECT count(*) FROM owners WHERE status = 'ambiguous') AS n_ambiguous, (SELECT count(*) FROM owners WHERE status = 'unowned') AS n_unowned FROM edges LEFT JOIN owners a ON src = a.node_key LEFT JOIN owners b ON dst = b.node_key", recursive=True))
def ownership_accounts(spark, sf):
    n, e = graph(spark, sf)
    return P.ownership_accounts(e, P.ownership(n, e)).select("n_candidates", "n_projected", "n_omitted", "n_ambiguous", "n_unowned")


@query(H(_ENDS + ", r AS (SELECT node_key, coalesce(package, '(none)') AS region FROM nodes), c AS (SELECT region, count(*) AS n_entities, count(*) FILTER (kind = 'file') AS n_file, count(*) FILTER (kind = 'method') AS n_method, count(*) FILTER (kind = 'test') AS n_test FROM nodes JOIN r USING (node_key) GROUP BY 1), x AS (SELECT coalesce(ap, '(none)') AS s, coalesce(bp, '(none)') AS d FROM ends WHERE coalesce(ap, '(none)') <> coalesce(bp, '(none)')) SELECT c.*, (SELECT count(*) FROM x WHERE s = region) AS n_out, (SELECT count(*) FROM x WHERE d = region) AS n_in FROM c"))
def region_counts(spark, sf):
    n, e = graph(spark, sf, form="plain")
    return P.region_counts(n, e, n.select("node_key", F.coalesce("package", F.lit("(none)")).alias("region")), ["file", "method", "test"])


@query(H(_ENDS + " SELECT ap AS src, bp AS dst, relation, count(*) AS n_edges FROM ends WHERE ap <> bp GROUP BY 1, 2, 3"))
def level_lift(spark, sf):
    n, e = graph(spark, sf, form="plain")
    return P.lift(e, n.where("package IS NOT NULL").select("node_key", F.col("package").alias("rep")))


@query(H(", s AS (SELECT * FROM nodes WHERE kind IN ('package', 'file') ORDER BY node_key LIMIT 500) SELECT edge_key, relation FROM edges WHERE src IN (SELECT node_key FROM s) AND dst IN (SELECT node_key FROM s) ORDER BY edge_key LIMIT 1000"))
def lod_filter(spark, sf):
    """A level's first 500 nodes and 1000 edges: the caps are its feature."""
    return P.lod_scope(*graph(spark, sf), ["package", "file"], 500, 1000)[1].select("edge_key", "relation")


@query("WITH f AS (SELECT CAST(vec_id AS VARCHAR) AS node_key, embedding[1] AS x, embedding[2] AS y, label AS fan_in FROM embeddings), g AS (SELECT *, CAST(x AS DOUBLE) - y AS px, (CAST(x AS DOUBLE) + y) / 2 AS py FROM f), b AS (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM g) SELECT node_key, round((px - x0) / (x1 - x0), 6) AS rx, round((py - y0) / (y1 - y0), 6) AS ry, round(least(40.0, 8 + 5 * log2(fan_in + 1)), 6) AS height FROM g, b")
def relief_height(spark, sf):
    v = T.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("node_key"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").alias("fan_in"))
    return P.relief(v)


@query("SELECT page_id, CASE WHEN path LIKE 'en/%' THEN 'en' WHEN path LIKE 'de/1%' THEN '.' ELSE '.' END AS root FROM (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages)")
def longest_prefix(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1).alias("path"))
    roots = spark.createDataFrame([(".",), ("en",), ("de/1",)], "root string")
    return p.join(P.longest_prefix(p.select("path").distinct(), roots), "path").select("page_id", "root")


# rules, mining, review

RULES = [{"id": "no-low-suppliers", "from": "c/*1", "deny": ["s/1*", "s/*7"], "severity": "error"}, {"id": "warn-all", "from": "**/2*", "deny": ["s/3"], "severity": "warning"}]


@query(H(_ENDS + """, v AS (SELECT 'no-low-suppliers' AS rule, 'error' AS severity, af AS f, bf AS t, relation FROM ends WHERE relation IN ('imports', 'calls') AND af LIKE 'c/%1' AND (bf LIKE 's/1%' OR bf LIKE 's/%7')
UNION ALL SELECT 'warn-all', 'warning', af, bf, relation FROM ends WHERE relation IN ('imports', 'calls') AND af LIKE '%/2%' AND bf = 's/3') SELECT DISTINCT rule, severity, 'file:' || f AS src, 'imports' AS relation, 'file:' || t AS dst FROM v"""))
def boundary_violations(spark, sf):
    n, e = graph(spark, sf)
    return R.violations(e, n, RULES).drop("evidence", "n_edges")


@query("WITH c AS (SELECT DISTINCT l_orderkey AS o, 'p' || l_partkey AS f FROM lineitem) SELECT a.f AS a, b.f AS b, count(*) AS n_commits, 'o' || min(a.o) AS newest FROM c a JOIN c b ON a.o = b.o AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 2")
def co_change(spark, sf):
    line = T.table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("sha"), F.col("l_orderkey").alias("ordinal"), F.concat(F.lit("p"), "l_partkey").alias("file"))
    return R.co_change(line)


_FLAGS = "SELECT 'k/' || (props->>'$.k') || '/' || user_id AS file, bool_or(event_type = 'click') AS planned, bool_or(event_type = 'view') AS retrieved, bool_or(event_type = 'purchase') OR bool_or(event_type = 'signup') AS modified FROM events WHERE event_type <> 'error' GROUP BY 1"


@query(f"SELECT *, modified AND NOT retrieved AS modified_not_retrieved, planned AND NOT modified AS planned_not_modified, modified AND NOT planned AS modified_not_planned FROM ({_FLAGS})")
def observation_overlay(spark, sf):
    e = C.agent_events(T.table(spark, sf, "events"))
    e = e.withColumn("file", F.concat_ws("/", "file", "task"))  # each task has files of its own
    return R.observation_overlay(*[e.where(F.col("role") == r) for r in ("planned", "read", "modified", "test_selected")])


@query("SELECT event_id, CASE WHEN k < 50 THEN 'accepted' ELSE 'unknown target' END AS outcome FROM (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events)")
def event_acceptance(spark, sf):
    good, bad = C.accept_events(C.agent_events(T.table(spark, sf, "events")), spark.range(50).select(F.concat(F.lit("k/"), "id").alias("file")))
    return good.select("event_id", F.lit("accepted").alias("outcome")).unionByName(bad.select("event_id", F.col("reason").alias("outcome")))


@query("WITH c AS (SELECT p_name || p_size AS name, count(*) AS n, min(p_partkey) AS one FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n = 1 THEN one ELSE -1 END AS candidate, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM part LEFT JOIN c ON name = p_name || (p_size + 1)")
def unique_match(spark, sf):
    """Every part asks for the one part of its name and the next size."""
    part = T.table(spark, sf, "part")
    probes = part.select("p_partkey", F.concat("p_name", (F.col("p_size") + 1).cast("string")).alias("probe"))
    found = part.select(F.concat("p_name", F.col("p_size").cast("string")).alias("probe"), F.col("p_partkey").alias("candidate"))
    return R.unique_match(probes, found, "probe").drop("probe").na.fill(-1, ["candidate"])


_SPANS = "SELECT 'c' || c_nationkey AS file, c_custkey AS node, c_custkey % 500 AS s_start, c_custkey % 500 + CAST(c_acctbal AS BIGINT) % 40 + 40 AS s_end FROM customer"


def _spans(spark, sf) -> DataFrame:
    return T.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("file"), F.col("c_custkey").alias("node"), (F.col("c_custkey") % 500).alias("s_start"), (F.col("c_custkey") % 500 + F.rint("c_acctbal").cast("long") % 40 + 40).alias("s_end"))


@query(f"SELECT file, point, node FROM (SELECT s.file, p.s_suppkey AS point, node, row_number() OVER (PARTITION BY s.file, p.s_suppkey ORDER BY s_end - s_start, s_start, node) AS k FROM ({_SPANS}) s JOIN supplier p ON s.file = 'c' || s_nationkey AND s_start <= s_suppkey * 7 % 500 AND s_suppkey * 7 % 500 <= s_end) WHERE k = 1")
def enclosing_symbol(spark, sf):
    points = T.table(spark, sf, "supplier").select(F.concat(F.lit("c"), "s_nationkey").alias("file"), F.col("s_suppkey").alias("point"), (F.col("s_suppkey") * 7 % 500).alias("at"))
    return I.enclosing(points, _spans(spark, sf))


@query(f"SELECT s_suppkey AS hunk, node FROM ({_SPANS}) s JOIN supplier ON file = 'c' || s_nationkey AND s_start <= s_suppkey % 500 + 5 AND s_end >= s_suppkey % 500")
def hunk_overlap(spark, sf):
    hunks = T.table(spark, sf, "supplier").select(F.concat(F.lit("c"), "s_nationkey").alias("file"), F.col("s_suppkey").alias("hunk"), (F.col("s_suppkey") % 500).alias("h_start"), (F.col("s_suppkey") % 500 + 5).alias("h_end"))
    return I.overlaps(hunks, _spans(spark, sf)).select("hunk", "node")


# views

_WALK = """, u AS (SELECT src, dst, edge_key FROM edges WHERE relation IN ('calls', 'imports') UNION ALL SELECT dst, src, edge_key FROM edges WHERE relation IN ('calls', 'imports')), a AS (SELECT sha256('node|function|part:1') AS node),
l1 AS (SELECT dst AS node, min(edge_key) AS seat, a.node AS parent FROM u JOIN a ON src = a.node WHERE dst <> a.node GROUP BY dst, a.node),
l2 AS (SELECT dst AS node, min(struct_pack(seat := seat || edge_key, parent := l1.node)) AS b FROM u JOIN l1 ON src = l1.node WHERE dst NOT IN (SELECT node FROM l1) AND dst NOT IN (SELECT node FROM a) GROUP BY dst)"""


def _walk(spark, sf) -> DataFrame:
    return V.walk_with_parents(graph(spark, sf)[1].where("relation IN ('calls', 'imports')"), keyed(spark, ANCHOR), 2)


@query(H(_WALK + " SELECT node, 1 AS hop, parent FROM l1 UNION ALL SELECT node, 2, b.parent FROM l2"))
def context_parents(spark, sf):
    return _walk(spark, sf).where("hop > 0").select("node", "hop", "parent")


@query(H(_WALK + " SELECT DISTINCT b.parent AS node FROM l2 JOIN nodes ON node_key = l2.node WHERE kind = 'file'"))
def context_connectors(spark, sf):
    files = graph(spark, sf)[0].where("kind = 'file'").select(F.col("node_key").alias("node"))
    walk = _walk(spark, sf)
    return V.connectors(walk, walk.where("hop = 2").join(files, "node", "left_semi"), 2)


@query(H(" SELECT kind, (kind IN ('file', 'test') AND coalesce(language IN ('BUILDING', 'SUPPLY'), false)) AS visible, count(*) AS n FROM nodes GROUP BY ALL"))
def visibility_flags(spark, sf):
    flagged = V.with_visibility(graph(spark, sf)[0], {"kind": ["file", "test"], "language": ["BUILDING", "SUPPLY"], "package": []})
    return flagged.groupBy("kind", "visible").agg(F.count("*").alias("n"))


@query(H(" SELECT src, relation, ['inferred', 'likely', 'certain'][min(list_position(['inferred', 'likely', 'certain'], confidence))] AS confidence, count(*) AS n_transitions FROM edges GROUP BY 1, 2"))
def weakest_confidence(spark, sf):
    return V.weakest_confidence(graph(spark, sf, form="plain")[1], ["src", "relation"]).withColumn("src", model.key_of_plain(F.col("src")))


@query(H(_OWNER + ", shown AS (SELECT node_key, CASE WHEN owner IS NULL OR owner = sha256('node|package|nation:' || (SELECT n_name FROM nation WHERE n_nationkey = 3)) THEN node_key ELSE owner END AS rep FROM owners), s1 AS MATERIALIZED (SELECT edges.*, rep AS a FROM edges JOIN shown ON src = node_key), s2 AS MATERIALIZED (SELECT s1.*, rep AS b FROM s1 JOIN shown ON dst = node_key) SELECT a AS src, b AS dst, relation, count(*) AS n_edges FROM s2 WHERE a <> b GROUP BY 1, 2, 3", recursive=True))
def collapsed_edges(spark, sf):
    n, e = graph(spark, sf)
    return V.collapsed_edges(e, P.ownership(n, e), [a_nation(spark, sf).first()[0]])


@query("SELECT CAST(p_partkey AS VARCHAR) AS node_key, round(100.0 * cos(CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 * (2 * pi())), 6) AS x, round(100.0 * sin(CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 * (2 * pi())), 6) AS y FROM part")
def layout_seed(spark, sf):
    return V.circle_seed(T.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("node_key")), "node_key", 100.0)


@query("SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS cx, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS cy, min(CAST(embedding[1] AS DOUBLE)) - 1 AS x0, max(CAST(embedding[1] AS DOUBLE)) + 1 AS x1, min(CAST(embedding[2] AS DOUBLE)) - 1 AS y0, max(CAST(embedding[2] AS DOUBLE)) + 1 AS y1 FROM embeddings GROUP BY 1")
def group_centroids(spark, sf):
    return V.centroids(_points(spark, sf), "label", 1.0)


def _points(spark, sf) -> DataFrame:
    return T.table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_APPENDED = """WITH p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), g AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1),
n AS (SELECT c_nationkey % 15 AS label, 'c' || c_custkey AS node, sha256('c' || c_custkey) AS h FROM customer)
SELECT n.label, node, round(coalesce(cx, (SELECT avg(x) FROM p)), 6) AS cx, round(coalesce(cy, (SELECT avg(y) FROM p)), 6) AS cy, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) / 4294967296.0 - 0.5 AS dx, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) / 4294967296.0 - 0.5 AS dy FROM n LEFT JOIN g USING (label)"""


def _appended(spark, sf) -> tuple[DataFrame, DataFrame]:
    placed = T.table(spark, sf, "embeddings").select("label", F.concat(F.lit("v"), "vec_id").alias("node"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return placed, T.table(spark, sf, "customer").select((F.col("c_nationkey") % 15).alias("label"), F.concat(F.lit("c"), "c_custkey").alias("node"))


@query(f"SELECT label, node, round(cx + dx, 6) AS x, round(cy + dy, 6) AS y FROM ({_APPENDED})")
def append_seeds(spark, sf):
    """Customers take places among the vectors of a label; labels 10 to 14 have no vector."""
    return Q.append_seeds(*_appended(spark, sf), "label").drop("cx", "cy")


# a corner begins an edge that has no point on its right and, of points in line, none beyond its ends; corners go round their mean, which lies inside
@query("""WITH p AS (SELECT DISTINCT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
e AS (SELECT a.label, a.x, a.y FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.label = a.label AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND ((c.x - a.x) * (c.x - b.x) > 0 OR (c.y - a.y) * (c.y - b.y) > 0))))),
k AS (SELECT DISTINCT * FROM e UNION SELECT * FROM p WHERE label IN (SELECT label FROM p GROUP BY 1 HAVING count(*) = 1)),
m AS (SELECT label, avg(x) AS cx, avg(y) AS cy, min((x, y)) AS s FROM k GROUP BY 1),
t AS (SELECT k.*, atan2(y - cy, x - cx) - atan2(s[2] - cy, s[1] - cx) AS turn, (x, y) = s AS first FROM k JOIN m USING (label))
SELECT label, row_number() OVER (PARTITION BY label ORDER BY NOT first, CASE WHEN turn < 0 THEN turn + 2 * pi() ELSE turn END) - 1 AS corner, x, y FROM t""")
def group_hulls(spark, sf):
    return V.hulls(_points(spark, sf), "label")


@query(H(", i AS (SELECT dst AS k, count(*) AS n FROM edges WHERE relation IN ('imports', 'calls') GROUP BY 1), o AS (SELECT src AS k, count(*) AS n, count(*) FILTER (resolution = 'unresolved') AS u FROM edges WHERE relation IN ('imports', 'calls') GROUP BY 1) SELECT node_key, concat_ws(',', CASE WHEN coalesce(i.n, 0) = 0 THEN 'no dependents' END, CASE WHEN i.n >= 5 THEN 'widely used' END, CASE WHEN o.n >= 5 THEN 'many dependencies' END, CASE WHEN u > 0 THEN 'unresolved references' END, CASE WHEN i.n > 0 AND coalesce(o.n, 0) = 0 THEN 'dependents without dependencies' END) AS remarks FROM nodes LEFT JOIN i ON i.k = node_key LEFT JOIN o ON o.k = node_key"))
def structural_remarks(spark, sf):
    n, e = graph(spark, sf, form="plain")
    use = e.where("relation IN ('imports', 'calls')")
    fan_out = use.groupBy(F.col("src").alias("node_key")).agg(F.count("*").alias("o"), F.count_if(F.col("resolution") == "unresolved").alias("u"))
    rows = n.select("node_key").join(use.groupBy(F.col("dst").alias("node_key")).agg(F.count("*").alias("i")), "node_key", "left").join(fan_out, "node_key", "left").na.fill(0, ["i", "o", "u"])
    return rows.select(model.key_of_plain(F.col("node_key")).alias("node_key"), F.array_join(V.interpretation(F.col("i"), F.col("o"), F.col("u")), ",").alias("remarks"))


# reports

_PW = "list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"SELECT p_partkey, 'p_name' AS field, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS word FROM (SELECT p_partkey, {_PW} AS w FROM part) UNION ALL SELECT p_partkey, 'p_brand', generate_subscripts(w, 1) - 1, unnest(w) FROM (SELECT p_partkey, list_filter(string_split_regex(lower(p_brand), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part)")
def search_postings(spark, sf):
    return Q.postings(T.table(spark, sf, "part"), "p_partkey", ["p_name", "p_brand"]).withColumn("place", F.col("place").cast("long"))


@query("WITH i AS (SELECT l_partkey AS p_partkey FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_partkey + 3 FROM lineitem WHERE l_linenumber = 7), n AS (SELECT p_partkey, count(*) AS n FROM i GROUP BY 1) SELECT coalesce(a.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'orphan' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS fault FROM part a FULL JOIN n ON a.p_partkey = n.p_partkey WHERE a.p_partkey IS NULL OR n IS NULL OR n > 1")
def index_faults(spark, sf):
    line = T.table(spark, sf, "lineitem")
    indexed = line.where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey")).union(line.where("l_linenumber = 7").select(F.col("l_partkey") + 3))
    return Q.index_faults(T.table(spark, sf, "part"), indexed, "p_partkey")


@query("WITH n AS (SELECT o_custkey + CASE WHEN o_orderstatus = 'P' THEN 100000000 ELSE 0 END AS c_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, 'missing' AS fault FROM customer ANTI JOIN n USING (c_custkey) UNION ALL SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer) THEN 'repeated' ELSE 'orphan' END FROM n WHERE n > 1 OR c_custkey NOT IN (SELECT c_custkey FROM customer)")
def index_faults_orders(spark, sf):
    """All orders index their customer; those of status P are indexed under a key that no customer has."""
    moved = F.when(F.col("o_orderstatus") == "P", 100000000).otherwise(0)
    return Q.index_faults(T.table(spark, sf, "customer"), T.table(spark, sf, "orders").select((F.col("o_custkey") + moved).alias("c_custkey")), "c_custkey")


@query("SELECT p_brand || '/' || p_size AS snapshot, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE 'mixed' END AS version FROM part GROUP BY 1")
def analyzer_versions(spark, sf):
    members = T.table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("snapshot"), F.col("p_type").alias("version"))
    return Q.analyzer_versions(members, "snapshot")


@query("SELECT count(DISTINCT v) AS n_mismatched FROM (SELECT p_type || p_size AS v FROM part UNION ALL SELECT s_nationkey || '' FROM supplier) WHERE v <> 'ECONOMY1'")
def mismatched_versions(spark, sf):
    a = T.table(spark, sf, "part").select(F.concat("p_type", F.col("p_size").cast("string")).alias("v"))
    return Q.mismatched(a, T.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("v")), "v", "ECONOMY1")


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def ranked_in_kind(spark, sf):
    return Q.ranked_in_kind(T.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")]).drop("p_retailprice").withColumn("rank", F.col("rank").cast("long"))


@query(RENAMED_SQL + ", p AS (SELECT * FROM pa UNION ALL SELECT r2.id, a2.id FROM r2 JOIN a2 ON r2.body = a2.body AND r2.kind = a2.kind AND r2.extractor = a2.extractor WHERE r2.c2 = 1 AND a2.c2 = 1) SELECT removed_id, added_id, CASE WHEN r.name = a.name THEN 'move' ELSE 'rename' END AS kind, least(removed_id * 10, added_id * 10) || ',' || greatest(removed_id * 10, added_id * 10) AS rows FROM p JOIN d r ON r.id = removed_id JOIN d a ON a.id = added_id")
def coalesced_rows(spark, sf):
    gone, come = renamed(spark, sf)
    raw = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 10).alias("index"))
    out = Q.coalesced_rows(D.rename_pairs(gone, come, "name", D.NODE_KEY), gone, come, raw)
    return out.withColumn("rows", F.array_join("rows", ","))


@query(H(", first AS (SELECT src, min(edge_key) AS k FROM edges WHERE relation = 'imports' GROUP BY 1) SELECT e.src, e.dst, e.origin FROM first JOIN edges e ON e.edge_key = k"))
def first_import(spark, sf):
    return Q.first_named_target(graph(spark, sf, form="named")[1], "imports")


@query(H(", w AS (SELECT node_key AS root, node_key AS node, 0 AS hop FROM nodes WHERE kind = 'package' UNION SELECT root, dst, hop + 1 FROM w JOIN edges ON src = node JOIN nodes n ON n.node_key = dst WHERE relation = 'contains' AND n.kind = 'package') SELECT root, node, min(hop) AS hop FROM w GROUP BY 1, 2", recursive=True))
def package_family(spark, sf):
    return Q.package_family(*graph(spark, sf)).select("root", "node", "hop")


@query("SELECT p.p_partkey AS id, t.p_partkey AS node_key FROM part p JOIN (SELECT min(p_partkey) AS p_partkey, split_part(p_name, ' ', 2) AS name FROM part GROUP BY 2) t ON list_contains(string_split(p.p_name, ' '), t.name)")
def type_mentions(spark, sf):
    part = T.table(spark, sf, "part")
    types = part.groupBy(F.split("p_name", " ")[1].alias("display_name")).agg(F.min("p_partkey").alias("node_key")).withColumn("qualified_name", F.concat(F.lit("q."), "display_name"))
    return Q.mentions(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("signature")), types)


@query(H(" SELECT 'nodes' AS claim, CAST(count(*) AS VARCHAR) AS value FROM nodes UNION ALL SELECT 'edges', CAST(count(*) AS VARCHAR) FROM edges UNION ALL SELECT 'packages', CAST(count(*) AS VARCHAR) FROM nodes WHERE kind = 'package' UNION ALL SELECT 'relation ' || r, CAST(count(edge_key) AS VARCHAR) FROM (SELECT unnest(['contains', 'imports', 'exports', 'references', 'calls', 'implements', 'extends', 'tests', 'routes_to', 'documents', 'changed_with']) AS r) LEFT JOIN edges ON relation = r GROUP BY r UNION ALL SELECT 'language ' || language, CAST(count(*) AS VARCHAR) FROM nodes WHERE kind = 'file' GROUP BY language UNION ALL SELECT 'severity ' || CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END, CAST(count(*) AS VARCHAR) FROM events GROUP BY 1"))
def repo_overview(spark, sf):
    n, e = graph(spark, sf)
    return Q.overview(n, e, T.table(spark, sf, "events").select(F.expr("CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END").alias("severity")))


@query(H(_OWNER + ", used AS (SELECT DISTINCT dst FROM edges WHERE relation IN ('imports', 'references', 'calls', 'implements', 'extends', 'routes_to')), q AS (SELECT 1 AS position, 'Which unresolved references matter?' AS question, count(*) AS n FROM edges WHERE resolution = 'unresolved' UNION ALL SELECT 2, 'Who owns the ambiguous nodes?', count(*) FROM owners WHERE status = 'ambiguous' UNION ALL SELECT 3, 'Which used nodes have no test?', count(*) FROM used WHERE dst NOT IN (SELECT dst FROM edges WHERE relation = 'tests') UNION ALL SELECT 4, 'Which files does nothing depend on?', count(*) FROM nodes WHERE kind = 'file' AND node_key NOT IN (SELECT dst FROM used)) SELECT * FROM q WHERE n > 0", recursive=True))
def interview_questions(spark, sf):
    n, e = graph(spark, sf)
    return Q.questions(n, e, P.ownership(n, e))


@query("WITH d AS (SELECT p_brand || '/' || p_size AS language, max(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END) AS d FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), o AS (SELECT p_brand || '/' || p_size AS language, max(CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END) AS o, count(*) AS n FROM part WHERE p_partkey % 2 = 1 GROUP BY 1) SELECT coalesce(d.language, o.language) AS language, coalesce(['inventory', 'structural', 'semantic'][d + 1], 'none') AS declared, coalesce(['inventory', 'structural', 'semantic'][o + 1], 'none') AS observed, coalesce(n, 0) AS n_rows, coalesce(o >= d, false) AS met FROM d FULL JOIN o ON d.language = o.language")
def capability_report(spark, sf):
    """Even parts declare, odd ones are observed."""
    rows = T.table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("language"), "p_partkey", F.expr("CASE p_type WHEN 'ECONOMY' THEN 'inventory' WHEN 'STANDARD' THEN 'structural' ELSE 'semantic' END").alias("capability"))
    return Q.capability_report(rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 = 1"))


@query(H(_OWNER + " SELECT n.node_key, CASE WHEN owner IS NOT NULL AND owner < '8' THEN owner ELSE n.node_key END AS representative FROM nodes n JOIN owners USING (node_key) WHERE n.kind IN ('method', 'function') AND n.display_name LIKE '%7'", recursive=True))
def hit_packages(spark, sf):
    n, e = graph(spark, sf)
    hits = n.where("kind IN ('method', 'function') AND display_name LIKE '%7'").select("node_key")
    return Q.representative_hits(hits, P.ownership(n, e), F.col("owner") < "8")


# text and events

@query(r"SELECT page_id, n, CAST(regexp_extract(h, '(?i)<h([1-6])', 1) AS INTEGER) AS level, trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS hs FROM pages))")
def doc_headings(spark, sf):
    return X.html_headings(T.table(spark, sf, "pages"), "page_id", "html").withColumn("n", F.col("n").cast("long"))


@query("""SELECT page_id, target, count(*) AS n_links FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s+href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1, 2""")
def doc_links(spark, sf):
    return X.html_links(T.table(spark, sf, "pages"), "page_id", "html")


@query("""WITH RECURSIVE g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
b AS (SELECT user_id, island, min(ts) AS first, 0 AS part FROM i GROUP BY 1, 2 UNION ALL SELECT b.user_id, b.island, (SELECT min(ts) FROM i WHERE i.user_id = b.user_id AND i.island = b.island AND i.ts > b.first + INTERVAL 48 HOUR), part + 1 FROM b WHERE EXISTS (SELECT 1 FROM i WHERE i.user_id = b.user_id AND i.island = b.island AND i.ts > b.first + INTERVAL 48 HOUR)),
c AS (SELECT i.user_id, i.island, i.ts, max(b.part) AS part FROM i JOIN b ON i.user_id = b.user_id AND i.island = b.island AND b.first <= i.ts GROUP BY i.event_id, i.user_id, i.island, i.ts)
SELECT user_id, CAST(island AS BIGINT) AS island, CAST(part AS BIGINT) AS part, min(ts) AS start, max(ts) AS end, count(*) AS n_events FROM c GROUP BY user_id, island, part""")
def debounce_batches(spark, sf):
    return R.debounce(T.table(spark, sf, "events"), "user_id", "12 HOURS", "48 HOURS")
