"""Queries over what captures, extractors, stores and readers see, made from the driver's tables; they register beside those of `catalog`."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tessera import model
from tessera.functions.shared import materialize, shared_dir
from tessera.operators import detail as V
from tessera.operators import extract as E
from tessera.operators import refresh
from tessera.operators import reports as Q
from tessera.operators import resolve as N
from tessera.operators import review as R
from tessera.operators import store
from tessera.operators import textlines as X
from tessera.operators import traverse as G
from tessera.operators import views
from tessera.plans.catalog import H, graph, plain, query
from tessera.sources import captures as C
from tessera.sources import testdata as T
from tessera.streaming import feeds

KEY = "p_partkey"


def pick(values: list[str], key: str = KEY):
    """The value at key modulo their number, in Spark."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(key), F.lit(len(values))).cast("int"))


def pick_sql(values: list[str], key: str = KEY) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_value({quoted})[CAST({key} % {len(values)} AS INTEGER) + 1]"


def text(*parts):
    """Strings and columns (names in braces) joined."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts])


# captured files

NAMES = ["x.ts", "x.D.TS", "x.mjs", "Dockerfile", "Makefile", "go.mod", "x.pyi", "run", "x.tar.gz", ".gitignore", "x.cc", "x.tfvars", "x.jsonc", "x.CMAKE", "a..md", "x.min.js", "CMakeLists.txt"]
SHEBANGS = ["#!/usr/bin/env python3", "#!/bin/zsh", "#!/usr/bin/node --x", ""]
FOLDERS = ["src", "site-packages", "generated", "a/target", ".terraform"]
_FILES = f"SELECT p_partkey, {pick_sql(FOLDERS, 'p_size')} || '/' || {pick_sql(NAMES)} AS path, {pick_sql(NAMES)} AS base, {pick_sql(SHEBANGS, 'p_size')} AS line FROM part"
_LANGUAGE = r"""CASE WHEN base = 'Dockerfile' THEN 'dockerfile' WHEN base = 'Makefile' THEN 'shell' WHEN base = 'go.mod' THEN 'toml' WHEN base = '.gitignore' THEN 'repository-config' WHEN base = 'CMakeLists.txt' THEN 'cmake'
 WHEN base IN ('x.ts', 'x.D.TS') THEN 'typescript' WHEN base IN ('x.mjs', 'x.min.js') THEN 'javascript' WHEN base = 'x.pyi' THEN 'python' WHEN base = 'x.cc' THEN 'cpp' WHEN base = 'x.tfvars' THEN 'terraform' WHEN base = 'x.jsonc' THEN 'json'
 WHEN base = 'x.CMAKE' THEN 'cmake' WHEN base = 'a..md' THEN 'markdown' WHEN line LIKE '%python3' THEN 'python' WHEN line LIKE '%zsh' THEN 'shell' WHEN line LIKE '%node %' THEN 'javascript' END"""


def files(spark, sf):
    part = T.table(spark, sf, "part")
    return part.select(KEY, F.concat_ws("/", pick(FOLDERS, "p_size"), pick(NAMES)).alias("path"), pick(SHEBANGS, "p_size").alias("line"))


@query(f"SELECT p_partkey, path, {_LANGUAGE} AS language FROM ({_FILES})")
def language_detect(spark, sf):
    return files(spark, sf).select(KEY, "path", C.language(F.col("path"), F.col("line")).alias("language"))


@query(f"SELECT p_partkey, coalesce(CASE language WHEN 'typescript' THEN base = 'x.D.TS' WHEN 'javascript' THEN base = 'x.min.js' WHEN 'python' THEN path LIKE 'site-packages/%' WHEN 'cpp' THEN path LIKE 'generated/%' WHEN 'terraform' THEN path LIKE '.terraform/%' END, false) AS generated FROM (SELECT *, {_LANGUAGE} AS language FROM ({_FILES}))")
def generated_paths(spark, sf):
    return files(spark, sf).select(KEY, C.is_generated(F.col("path"), C.language(F.col("path"), F.col("line"))).alias("generated"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'excluded' WHEN doc_id % 5 = 0 THEN 'ignored' WHEN octet_length(encode(text)) > 4000 THEN 'too_large' END AS reason, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def scan_reasons(spark, sf):
    d = T.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 7 == 0, text("node_modules/", "{doc_id}")).when(F.col("doc_id") % 5 == 0, text("{doc_id}", ".tmp")).otherwise(text("src/", "{doc_id}")).alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size"))
    return C.scan(d, ["*.tmp"], most_bytes=4000).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "reason", "hash")


@query("SELECT 'r' || o_custkey % 5 || '/d' || o_orderkey % 3 || '/f' || o_orderkey AS path, CASE WHEN o_custkey % 5 = 1 AND o_orderkey % 3 = 2 THEN 'deep' WHEN o_custkey % 5 = 1 THEN 'one' ELSE 'root' END AS package FROM orders")
def nearest_manifest(spark, sf):
    paths = T.table(spark, sf, "orders").select(F.concat(F.lit("r"), F.col("o_custkey") % 5, F.lit("/d"), F.col("o_orderkey") % 3, F.lit("/f"), "o_orderkey").alias("path"))
    return C.nearest_manifest(paths, spark.createDataFrame([("", "root"), ("r1", "one"), ("r1/d2", "deep"), ("r2", None)], "folder string, name string"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS sha, 0 AS ordinal, unnest(['c/' || o_custkey, 's/' || o_orderkey % 10]) AS file FROM orders UNION ALL SELECT CAST(o_orderkey + 1 AS VARCHAR), 1, 'last' FROM orders")
def git_history(spark, sf):
    """Each order is a log of two commits."""
    log = T.table(spark, sf, "orders").select(F.concat(F.lit("commit:"), "o_orderkey", F.lit("\n\nc/"), "o_custkey", F.lit("\ns/"), F.col("o_orderkey") % 10, F.lit("\n\ncommit:"), F.col("o_orderkey") + 1, F.lit("\r\n\r\nlast\r\n")).alias("text"))
    return C.commit_files(log)


_PLACES = "SELECT o_orderkey, 'r' || o_custkey % 4 || '/d' || o_orderkey % 3 || '/f' AS path, CASE o_orderkey % 2 WHEN 0 THEN 'python' ELSE 'go' END AS language FROM orders"


@query(f"SELECT DISTINCT path, language, CASE WHEN path LIKE 'r1/d2/%' AND language = 'python' THEN 'r1/d2' WHEN path LIKE 'r1/%' AND language = 'go' THEN 'r1' WHEN language = 'python' THEN '.' END AS project FROM (SELECT path || o_orderkey AS path, language FROM ({_PLACES}))")
def project_roots(spark, sf):
    o = T.table(spark, sf, "orders").select(F.concat(F.lit("r"), F.col("o_custkey") % 4, F.lit("/d"), F.col("o_orderkey") % 3, F.lit("/f"), "o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 2 == 0, "python").otherwise("go").alias("language"))
    return N.with_projects(o, spark.createDataFrame([(".", ["python"]), ("r1", ["go"]), ("r1/d2", ["python"])], "root string, languages array<string>"))


MANIFESTS = {"package.json": ("typescript", "javascript"), "go.mod": ("go",)}


@query(r"SELECT sha256('project|' || path) AS id, CASE WHEN d = '' THEN '.' ELSE d END AS root, m AS manifest, CASE m WHEN 'go.mod' THEN 'go' ELSE 'javascript,typescript' END AS languages FROM (SELECT CASE WHEN d = '' THEN m ELSE d || '/' || m END AS path, d, m FROM (SELECT CASE WHEN s_suppkey = 0 THEN '' ELSE 'a/' || s_suppkey END AS d, list_value('package.json', 'go.mod', 'x.json')[CAST(s_suppkey % 3 AS INTEGER) + 1] AS m FROM supplier)) WHERE m <> 'x.json'")
def project_discovery(spark, sf):
    name = F.get(F.array(F.lit("package.json"), F.lit("go.mod"), F.lit("x.json")), F.pmod("s_suppkey", F.lit(3)).cast("int"))
    found = T.table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") == 0, name).otherwise(F.concat(text("a/", "{s_suppkey}", "/"), name)).alias("path"))
    return E.projects(found, MANIFESTS).withColumn("languages", F.array_join("languages", ","))


# stores

@query(T.nodes_sql())
def snapshot_nodes(spark, sf):
    return graph(spark, sf)[0]


@query(T.edges_sql())
def snapshot_edges(spark, sf):
    return graph(spark, sf)[1]


@query(H(" SELECT 'nodes' AS name, 2 AS snapshot, count(*) AS n FROM nodes WHERE kind IN ('package', 'file') UNION ALL SELECT 'edges', 2, count(*) FROM edges WHERE relation = 'contains' AND dst IN (SELECT node_key FROM nodes WHERE kind IN ('package', 'file')) UNION ALL SELECT 'activations', 3, 3"))
def snapshot_prune(spark, sf):
    """A, B, A' with A' equal to B: the third activation reuses the second snapshot, the first is pruned."""
    n, e = graph(spark, sf)
    n = n.where("kind IN ('package', 'file')")
    e = e.where("relation = 'contains'").join(n.select(F.col("node_key").alias("dst")), "dst", "left_semi")
    own = store.SnapshotStore(spark, f"{shared_dir(spark)}/prune-{uuid.uuid4().hex}")
    own.publish(n.where("kind = 'package'"), e.limit(0), "a", None)
    own.publish(n, e, "b", 1)
    own.publish(n, e, "b", 2)
    own.prune(1)
    rows = lambda table: own.spark.read.parquet(f"{own.root}/{table}").groupBy(F.lit(table).alias("name"), F.col("snapshot_id").alias("snapshot")).agg(F.count("*").alias("n"))
    return rows("nodes").unionByName(rows("edges")).unionByName(own.activations().agg(F.lit("activations").alias("name"), F.max("activation_id").cast("int").alias("snapshot"), F.count("*").alias("n")))


@query("""WITH k AS (SELECT p_name AS key, CAST(p_partkey AS VARCHAR) AS identity, 0 AS collision_index FROM part WHERE p_partkey % 2 = 1), f AS (SELECT p_name AS key, CAST(p_partkey AS VARCHAR) AS identity FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 2 = 0),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY identity) - 1 + (SELECT count(*) FROM k WHERE k.key = f.key) AS INTEGER) AS c FROM f) SELECT * FROM k UNION ALL SELECT CASE WHEN c = 0 THEN key ELSE sha256(identity || '|' || c) END, identity, c FROM n""")
def stable_upsert(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_name").alias("key"), F.col(KEY).cast("string").alias("identity"), KEY)
    return store.stable_upsert(p.where("p_partkey % 2 = 1").drop(KEY), p.where("p_partkey % 4 <> 3").drop(KEY), "key", "identity").select("key", "identity", "collision_index")


@query("SELECT o_custkey AS retrieval, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, o_orderkey AS node FROM orders")
def retrieval_log(spark, sf):
    rows = Q.ranked_in_kind(T.table(spark, sf, "orders").select(F.col("o_custkey").alias("retrieval"), F.col("o_orderkey").alias("node"), "o_totalprice"), "retrieval", [F.desc("o_totalprice"), F.asc("node")])
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    Q.append_checked(rows.select("retrieval", "rank", "node"), path, ["retrieval", "rank"], ["node"])
    return spark.read.parquet(path)


RULES_TEXT = json.dumps({"boundaries": [{"id": "a", "from": "src/**", "deny": ["db/*", "**/x"], "severity": "warning"}, {"id": "b", "from": "*", "deny": ["y"]}]})


@query("SELECT * FROM (VALUES ('a', 'src/**', 'warning', 'db/*,**/x'), ('b', '*', 'error', 'y')) t(id, origin, severity, deny)")
def rules_parsed(spark, sf):
    return spark.createDataFrame([(r["id"], r["from"], r["severity"], ",".join(r["deny"])) for r in R.parse_rules(RULES_TEXT)], "id string, origin string, severity string, deny string")


_MERGED = ", f AS (SELECT DISTINCT file FROM nodes WHERE kind = 'file' AND language = 'BUILDING'), gone AS (SELECT node_key FROM nodes WHERE file IN (SELECT file FROM f) AND kind = 'test')"


@query(H(_MERGED + " SELECT relation, count(*) AS n_edges FROM edges WHERE src NOT IN (SELECT node_key FROM gone) GROUP BY 1"))
def region_merge(spark, sf):
    """The files of one segment come again without their tests."""
    n, e = graph(spark, sf, form="plain")[0], model.passing(graph(spark, sf, form="named")[1])
    changed = n.where("kind = 'file' AND language = 'BUILDING'").select("file").distinct()
    own = n.join(changed, "file", "left_semi").where("kind <> 'test'")
    new = e.join(own.select(F.col("node_key").alias("src")), "src", "left_semi")
    return store.merge_region(n, e, own, new, changed)[1].groupBy("relation").agg(F.count("*").alias("n_edges"))


@query("WITH RECURSIVE w AS (SELECT CAST(5 AS BIGINT) AS d UNION SELECT doc_id FROM documents JOIN w ON doc_id // 2 = d AND doc_id > 0) SELECT 'same' AS case_, 'noop' AS mode, 'nothing changed' AS reason, 0 AS n_files UNION ALL SELECT 'one', 'regional', 'proved', CAST(count(*) AS INTEGER) FROM w UNION ALL SELECT 'added', 'full', 'files added or removed', 0 UNION ALL SELECT 'other', 'full', 'language without regional proof', 0 UNION ALL SELECT 'hint', 'full', 'rename or rescan', 0")
def refresh_decision(spark, sf):
    """Document n imports document n / 2; document 5 changes."""
    d = T.table(spark, sf, "documents").select("doc_id", text("f", "{doc_id}").alias("path"), F.sha2("text", 256).alias("hash"), F.lit("typescript").alias("language"))
    imports = d.where("doc_id > 0").select(F.col("path").alias("src"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 2)).alias("dst"))
    one = d.withColumn("hash", F.when(F.col("doc_id") == 5, "x").otherwise(F.col("hash")))
    cases = {"same": (d, {}), "one": (one, {}), "added": (one.unionByName(d.limit(1).withColumn("path", F.lit("new"))), {}), "other": (one.withColumn("language", F.lit("python")), {}), "hint": (one, {"hints": ("rename",)})}
    got = {k: refresh.decide(d.drop("doc_id"), now.drop("doc_id"), imports, **more) for k, (now, more) in cases.items()}
    return spark.createDataFrame([(k, x.mode, x.reason, x.region.count() if x.region is not None else 0) for k, x in got.items()], "case_ string, mode string, reason string, n_files int")


# filters and details

@query(H(" SELECT node_key, kind, package FROM nodes WHERE kind IN ('method', 'test') AND starts_with(qualified_name, 'order:1') AND file = 'c/7' UNION ALL SELECT node_key, kind, package FROM nodes WHERE kind = 'file' AND package = (SELECT n_name FROM nation WHERE n_nationkey = 3)"))
def node_filter(spark, sf):
    n = graph(spark, sf)[0]
    name = T.table(spark, sf, "nation").where("n_nationkey = 3").first()["n_name"]
    return V.filter_nodes(n, ["method", "test"], file="c/7", prefix="order:1").unionByName(V.filter_nodes(n, ["file"], package=name)).select("node_key", "kind", "package")


@query(H(" SELECT relation, origin, count(*) AS n_edges FROM edges WHERE relation IN ('calls', 'tests') AND origin IN ('compiler') AND resolution IN ('resolved', 'partial') GROUP BY 1, 2"))
def edge_filter(spark, sf):
    return V.filter_edges(graph(spark, sf)[1], ["calls", "tests"], ["compiler"], None, ["resolved", "partial"]).groupBy("relation", "origin").agg(F.count("*").alias("n_edges"))


@query(H(" SELECT node_key AS \"entityKey\", kind, qualified_name AS \"qualifiedName\", display_name AS \"displayName\", file, package AS \"packageName\", language FROM nodes"))
def wire_nodes(spark, sf):
    return V.wire(graph(spark, sf)[0], V.WIRE_NODE)


_WANTED = ["order:1", "part:7", "nobody", "re wi", "c/7"]


@query(H(", q AS (SELECT unnest(['" + "', '".join(_WANTED) + "']) AS query), c AS (SELECT query, (SELECT count(*) FROM nodes WHERE qualified_name = query) AS nq, (SELECT min(node_key) FROM nodes WHERE qualified_name = query) AS kq, (SELECT count(*) FROM nodes WHERE display_name = query) AS nd, (SELECT min(node_key) FROM nodes WHERE display_name = query) AS kd FROM q) SELECT query, CASE WHEN nq = 1 OR (nq = 0 AND nd = 1) THEN 'ok' WHEN nq > 1 OR nd > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN nq = 1 THEN kq WHEN nq = 0 AND nd = 1 THEN kd END AS node_key, CASE WHEN nq > 0 THEN nq ELSE nd END AS n_candidates FROM c"))
def entity_resolution(spark, sf):
    return V.resolve_entity(graph(spark, sf)[0], spark.createDataFrame([(w,) for w in _WANTED], "query string"))


@query(H(", k AS (SELECT sha256('node|function|part:7') AS k), b AS (SELECT 'out' AS direction, edge_key, relation, dst AS other FROM edges, k WHERE src = k UNION ALL SELECT 'in', edge_key, relation, src FROM edges, k WHERE dst = k) SELECT 'part:7' AS query, 'ok' AS status, k AS node_key, direction, edge_key, relation, other, (SELECT count(*) FROM b WHERE direction = 'in' AND relation IN ('imports', 'references', 'calls', 'implements', 'extends', 'routes_to')) AS fan_in FROM b, k"))
def node_detail(spark, sf):
    n, e = graph(spark, sf, form="named")
    return V.node_detail(n, model.plain_ends(e), spark.createDataFrame([("part:7",)], "query string"))


@query("SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name, CAST(p_partkey AS VARCHAR)) AS position, CAST(p_partkey AS VARCHAR) AS node_key, p_retailprice AS weight FROM part QUALIFY position <= 5")
def top_labels(spark, sf):
    """Five labels a brand: the limit is the feature."""
    part = T.table(spark, sf, "part").select("p_brand", F.col(KEY).cast("string").alias("node_key"), F.col("p_name").alias("display_name"), "p_retailprice")
    return V.top_labels(part, F.col("p_retailprice"), "p_brand", 5).withColumn("position", F.col("position").cast("long"))


@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN 'body' WHEN length(s) <= 600 THEN 'signature' ELSE 'name' END AS kind, sha256(CASE WHEN length(text) <= 600 THEN text WHEN length(s) <= 600 THEN s ELSE n END) AS text FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source || ':' || lang END AS s, 'd' || doc_id AS n FROM documents)")
def representation(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.concat("source", F.lit(":"), "lang")).alias("s"), text("d", "{doc_id}").alias("n"))
    return d.select("doc_id", views.representation(F.col("text"), F.col("s"), F.col("n"), 600).alias("x")).select("doc_id", "x.kind", F.sha2("x.text", 256).alias("text"))


@query("SELECT l_partkey, array_to_string(e[1:20], ',') AS evidence, CAST(greatest(len(e) - 20, 0) AS INTEGER) AS n_omitted FROM (SELECT l_partkey, list_sort(list(l_orderkey * 10 + l_linenumber)) AS e FROM lineitem GROUP BY 1)")
def evidence_page(spark, sf):
    rows = T.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("e"))
    some, left = views.first_evidence(F.col("e"))
    return rows.select("l_partkey", F.array_join(some, ",").alias("evidence"), left.alias("n_omitted"))


@query("SELECT s_suppkey, (SELECT count(*) FROM supplier) > 7 AS more FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")
def page_probe(spark, sf):
    """A page of seven: the limit is the feature."""
    got, more = Q.first_rows(T.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")], 7)
    return spark.createDataFrame([(r["s_suppkey"], more) for r in got], "s_suppkey long, more boolean")


@query("SELECT 'd' || l_orderkey AS doc, 'p' || l_partkey AS node, CASE l_returnflag WHEN 'R' THEN 'certain' ELSE 'likely' END AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 2 AND p_type = 'ECONOMY'")
def documents_of(spark, sf):
    line = T.table(spark, sf, "lineitem").select(text("d", "{l_orderkey}").alias("src"), F.when(F.col("l_linenumber") <= 2, "documents").otherwise("calls").alias("relation"), text("p", "{l_partkey}").alias("dst"), F.when(F.col("l_returnflag") == "R", "certain").otherwise("likely").alias("confidence"))
    return Q.documents_of(line, T.table(spark, sf, "part").where("p_type = 'ECONOMY'").select(text("p", "{p_partkey}").alias("node")))


@query("WITH p AS (SELECT CAST(vec_id AS VARCHAR) AS node, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), o AS (SELECT x AS ox, y AS oy FROM p WHERE node = '0') SELECT node FROM p, o WHERE node <> '0' AND x - ox > 0 AND x - ox >= abs(y - oy) ORDER BY sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)), node LIMIT 1")
def directional_neighbour(spark, sf):
    v = T.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("node"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return Q.nearest_in_direction(v, "0", 1, 0)


@query("SELECT CAST(p_partkey AS VARCHAR) AS node_key, p_type AS badge, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, vec_id IS NOT NULL AS placed FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def badges(spark, sf):
    at = T.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("node_key"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return Q.badges(T.table(spark, sf, "part").select(F.col(KEY).cast("string").alias("node_key"), F.col("p_type").alias("badge")), at)


@query(H(" SELECT 1 AS case_, 'ok' AS status UNION ALL SELECT 2, 'no_path' UNION ALL SELECT 3, 'search_limit'"))
def path_status(spark, sf):
    """From a file over `contains` and calls to a part that it calls, to its package, and over too few edges. The call is the first by names: each search must be asked for the same."""
    e = graph(spark, sf, form="plain")[1]
    call = e.where("relation = 'calls'").agg(F.min(F.struct("src", "dst")).alias("x")).first()["x"] or {"src": None, "dst": None}
    owner = materialize(e.where((F.col("relation") == "contains") & (F.col("dst") == call["src"])).select(F.col("src").alias("node")), "owner")
    goal, top = spark.createDataFrame([(call["dst"],)], "node string"), plain(spark, ("package", "region:ASIA"))
    found = [G.path_search(e, owner, target, 1, most, relations=("contains", "calls"), key=model.edge_key_of_plain()).status for target, most in ((goal, 64), (top, 64), (goal, 1))]
    return spark.createDataFrame(list(enumerate(found, 1)), "case_ int, status string")


@query("WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), i AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 7 <> 0), w AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'y' WHEN doc_id % 4 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0), a AS (SELECT d.doc_id, h.h AS hh, i.h AS ih, w.h AS wh FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id LEFT JOIN w ON d.doc_id = w.doc_id), s AS (SELECT 'f' || doc_id AS path, CASE WHEN hh IS NULL AND ih IS NOT NULL THEN 'added' WHEN hh IS NOT NULL AND ih IS NULL THEN 'removed' WHEN hh <> ih THEN 'modified' END AS staged, CASE WHEN ih IS NULL AND wh IS NOT NULL THEN CASE WHEN hh IS NULL THEN 'untracked' ELSE 'added' END WHEN ih IS NOT NULL AND wh IS NULL THEN 'removed' WHEN ih <> wh THEN 'modified' END AS unstaged FROM a) SELECT * FROM s WHERE staged IS NOT NULL OR unstaged IS NOT NULL")
def working_tree_diff(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", text("f", "{doc_id}").alias("path"), F.sha2("text", 256).alias("hash"))
    staged = F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("hash"))
    tree = F.when(F.col("doc_id") % 6 == 0, "y").otherwise(staged)
    return V.working_tree_diff(d.where("doc_id % 5 <> 0").select("path", "hash"), d.where("doc_id % 7 <> 0").select("path", staged.alias("hash")), d.where("doc_id % 11 <> 0").select("path", tree.alias("hash")))


_LIVE = "WITH b AS (SELECT 'd' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), l AS (SELECT CASE WHEN doc_id % 10 = 1 THEN 'new/' || doc_id ELSE 'd' || doc_id END AS path, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT 'd' || doc_id AS removed_id, 'new/' || doc_id AS added_id FROM documents WHERE doc_id % 10 = 1 AND doc_id % 7 <> 0)"


@query(_LIVE + " SELECT coalesce(b.path, l.path) AS path, removed_id AS old_path, CASE WHEN removed_id IS NOT NULL THEN 'renamed' WHEN b.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'removed' WHEN b.h = l.h THEN 'unchanged' ELSE 'modified' END AS status FROM b FULL JOIN l ON b.path = l.path LEFT JOIN r ON coalesce(b.path, l.path) = added_id WHERE coalesce(b.path, l.path) NOT IN (SELECT removed_id FROM r)")
def live_comparison(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", text("d", "{doc_id}").alias("path"), F.sha2("text", 256).alias("hash"))
    moved = d.where("doc_id % 10 = 1 AND doc_id % 7 <> 0").select(F.col("path").alias("removed_id"), text("new/", "{doc_id}").alias("added_id"))
    live = d.where("doc_id % 7 <> 0").select(F.when(F.col("doc_id") % 10 == 1, text("new/", "{doc_id}")).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return V.live_comparison(d.where("doc_id % 5 <> 0").select("path", "hash"), live, moved)


_STEPS = "SELECT user_id, event_id AS seq, CAST(props->>'$.k' AS BIGINT) AS generation, CASE event_type WHEN 'view' THEN 'change' WHEN 'click' THEN 'start' WHEN 'error' THEN 'fail' ELSE 'done' END AS kind FROM events"


@query(f"SELECT user_id, seq, generation, kind, CASE WHEN kind = 'change' THEN 'dirty' WHEN generation < newest THEN 'obsolete' WHEN kind = 'start' THEN 'running' WHEN kind = 'done' THEN 'settled' ELSE 'error' END AS state FROM (SELECT *, max(CASE WHEN kind = 'change' THEN generation END) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS newest FROM ({_STEPS}))")
def refresh_states(spark, sf):
    kind = F.expr("CASE event_type WHEN 'view' THEN 'change' WHEN 'click' THEN 'start' WHEN 'error' THEN 'fail' ELSE 'done' END")
    return V.refresh_states(T.table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("generation"), kind.alias("kind")), "user_id")


@query("WITH a AS (SELECT user_id, event_id AS seq, CAST(props->>'$.k' AS BIGINT) % 3 AS s FROM events WHERE event_type = 'purchase'), p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY seq) AS previous FROM a) SELECT user_id, seq, CASE WHEN previous IS NULL OR previous = s THEN 'settled' ELSE 'replaced' END AS event, previous FROM p UNION ALL SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'pending' ELSE 'settled' END, NULL FROM events WHERE event_type <> 'purchase'")
def rotation_events(spark, sf):
    e = T.table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), "event_type", (F.get_json_object("props", "$.k").cast("long") % 3).alias("snapshot_id"))
    tried = e.where("event_type <> 'purchase'").withColumn("outcome", F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN NULL ELSE 'done' END"))
    return V.rotations(e.where("event_type = 'purchase'"), tried, "user_id")


# extraction

_CODE = [("python", "import os\nclass A{0}(B):\n    async def run(self):\n        pass"), ("go", "func (x *T) Do{0}() {{}}\ntype S{0} struct"), ("rust", "pub fn f{0}() {{}}\n  pub enum E{0} {{}}"), ("shell", "x=1\nbuild{0}() {{\n"), ("dockerfile", "FROM a AS stage{0}\nRUN x")]
_DECLARED = {"python": [(2, "class", "A{0}"), (3, "function", "run")], "go": [(1, "function", "Do{0}"), (2, "type", "S{0}")], "rust": [(1, "function", "f{0}"), (2, "type", "E{0}")], "shell": [(2, "function", "build{0}")], "dockerfile": [(1, "type", "stage{0}")]}


def code(spark, sf):
    body = None
    for i, (language, template) in enumerate(_CODE):
        mine = F.pmod(F.col(KEY), F.lit(len(_CODE))) == i
        own = F.struct(F.lit(language).alias("language"), F.replace(F.lit(template.replace("{{", "{").replace("}}", "}")), F.lit("{0}"), F.col(KEY).cast("string")).alias("text"))
        body = F.when(mine, own) if body is None else body.when(mine, own)
    return T.table(spark, sf, "part").select(text("p/", "{p_partkey}").alias("path"), body.alias("b")).select("path", "b.*")


@query(" UNION ALL ".join(f"SELECT 'p/' || p_partkey AS path, {n} AS n, '{kind}' AS kind, replace('{name}', '{{0}}', CAST(p_partkey AS VARCHAR)) AS name FROM part WHERE p_partkey % {len(_CODE)} = {i}" for i, (language, _) in enumerate(_CODE) for n, kind, name in _DECLARED[language]))
def line_declarations(spark, sf):
    return E.declarations(code(spark, sf))


_BRACED = {
    "c": ("struct s{0} {\n  int a;\n};\nint f{0}(int a);\nstatic char *g{0}(int a) {\n  return h(a);\n}\ntypedef unsigned u{0};", [(1, "type", "s{0}"), (5, "function", "g{0}"), (8, "type", "u{0}")]),
    "cpp": ("class K{0} : public B {\n};\nvoid K{0}::run(int a) {\n  go(a);\n}\nenum class E{0} {\n};", [(1, "class", "K{0}"), (3, "function", "run"), (6, "type", "E{0}")]),
    "java": ("public final class C{0} {\n  C{0}(int a) {\n    if (a > 0) {\n      go(a);\n    }\n  }\n  abstract List<String> m{0}(int a);\n}\ninterface I{0} {\n}\nrecord R{0}(int x) {\n}", [(1, "class", "C{0}"), (2, "method", "C{0}"), (7, "method", "m{0}"), (9, "interface", "I{0}"), (11, "type", "R{0}")]),
    "rust": ("pub trait T{0} {\n  fn f(&self);\n}", [(1, "interface", "T{0}"), (2, "function", "f")]),
}


@query(" UNION ALL ".join(f"SELECT '{language}/' || s_suppkey AS path, {n} AS n, '{kind}' AS kind, replace('{name}', '{{0}}', CAST(s_suppkey AS VARCHAR)) AS name FROM supplier" for language, (_, found) in _BRACED.items() for n, kind, name in found))
def braced_declarations(spark, sf):
    """Each supplier is a file in four languages."""
    files = F.array(*[F.struct(F.concat(F.lit(f"{language}/"), "s_suppkey").alias("path"), F.lit(language).alias("language"), F.replace(F.lit(body), F.lit("{0}"), F.col("s_suppkey").cast("string")).alias("text")) for language, (body, _) in _BRACED.items()])
    return E.declarations(T.table(spark, sf, "supplier").select(F.inline(files)))


@query(f"SELECT 'p/' || p_partkey AS path, {pick_sql([str(t.count(chr(10)) + 1) for _, t in _CODE])}::BIGINT AS n_lines FROM part")
def plugin_rows(spark, sf):
    """A plug-in that counts lines."""
    return E.extracted(code(spark, sf), _line_count, "path string, n_lines long")


def _line_count(path, body):
    yield {"path": path, "n_lines": body.count("\n") + 1}


@query("SELECT p_partkey, unnest([1, 2, 4, 6]) AS n, unnest([1, 2, 3, 2]) AS level, unnest(['A' || p_partkey, 'B', p_name, 'D']) AS title, unnest([NULL, 1, 2, 1]) AS parent FROM part")
def markdown_sections(spark, sf):
    md = T.table(spark, sf, "part").select(KEY, text("# A", "{p_partkey}", "\n## B\ntext\n### ", "{p_name}", " ##\n#no\n## D").alias("t"))
    return X.markdown_sections(md, KEY, "t")


@query("SELECT p_partkey, unnest([1, 1, 2]) AS n, unnest(['f' || p_partkey || '()', 'a/' || p_size || '.ts', p_brand]) AS term FROM part")
def backtick_terms(spark, sf):
    md = T.table(spark, sf, "part").select(KEY, text("See `f", "{p_partkey}", "()` and `a/", "{p_size}", ".ts`.\n`", "{p_brand}", "` ``").alias("t"))
    return X.backtick_terms(md, KEY, "t")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/b' || p_size || '/[id]' WHEN 1 THEN '/' WHEN 2 THEN '/u' || p_size END AS route FROM part")
def next_routes(spark, sf):
    p = T.table(spark, sf, "part").withColumn("k", F.col(KEY) % 4).select(KEY, F.when(F.col("k") == 0, text("src/app/(g)/b", "{p_size}", "/[id]/page.tsx")).when(F.col("k") == 1, "app/page.js").when(F.col("k") == 2, text("app/u", "{p_size}", "/route.ts")).otherwise("lib/page.ts").alias("path"))
    return p.select(KEY, X.next_route(F.col("path")).alias("route"))


@query("SELECT 'p/' || p_partkey AS path, unnest([1, 2, 3]) AS n, unnest(['GET', 'POST', 'USE']) AS method, unnest(['/api/' || p_partkey, NULL, '/x']) AS route, unnest(['h' || p_size, 'make', 'mw.run']) AS handler, unnest(['resolved', 'unresolved', 'resolved']) AS resolution FROM part")
def express_routes(spark, sf):
    src = T.table(spark, sf, "part").select(text("p/", "{p_partkey}").alias("path"), text("app.get('/api/", "{p_partkey}", "', h", "{p_size}", ");\nrouter.post(base + x, make);\napp.use(`/x`, mw.run)\nmap.get(1)").alias("t"))
    return N.express_routes(X.lines_of(src, "path", "t"))


@query("SELECT o_orderkey, 'c/' || o_custkey AS file, CAST(o_orderkey % 90 + 1 AS INTEGER) AS h_start, CAST(o_orderkey % 90 + 3 AS INTEGER) AS h_end FROM orders UNION ALL SELECT o_orderkey, 'gone', 5, 9 FROM orders")
def diff_hunks(spark, sf):
    d = T.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("--- a/c/"), "o_custkey", F.lit("\n+++ b/c/"), "o_custkey", F.lit("\n@@ -1,9 +"), F.col("o_orderkey") % 90 + 1, F.lit(",3 @@\n a\n--- a/gone\n+++ /dev/null\n@@ -5,5 +0,0 @@\n-x")).alias("t"))
    return X.diff_hunks(d, "o_orderkey", "t").select("o_orderkey", "file", "h_start", "h_end")


@query("WITH s AS (SELECT 'GET /b' || p_size || '/*' AS k, min(p_partkey) AS one, count(*) AS n FROM part WHERE p_partkey % 40 = 0 GROUP BY 1) SELECT p_partkey, CASE WHEN n = 1 THEN one END AS candidate, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM part LEFT JOIN s ON k = 'GET /b' || p_size || '/*'")
def http_links(spark, sf):
    part = T.table(spark, sf, "part")
    servers = part.where("p_partkey % 40 = 0").select(F.lit("get").alias("method"), text("/b", "{p_size}", "/:id").alias("route"), F.col(KEY).alias("candidate"))
    return E.http_links(part.select(KEY, F.lit("GET").alias("method"), text("https://h.example/b", "{p_size}", "/", "{p_partkey}", "/?q=1#f").alias("url")), servers).select(KEY, "candidate", "status")


@query(H(" SELECT derivation, reason, count(*) AS n FROM (SELECT CASE WHEN origin = 'compiler' THEN 'type_checked' WHEN relation = 'contains' THEN 'structural' ELSE 'matched' END AS derivation, CASE WHEN resolution = 'unresolved' THEN 'target not found' END AS reason FROM edges) GROUP BY 1, 2"))
def edge_provenance(spark, sf):
    return E.with_provenance(graph(spark, sf)[1], "lines", "1").groupBy("derivation", "reason").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_type AS code, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, CASE WHEN k % 3 = 0 THEN event_type ELSE 'm' || k END AS message, 'f' || user_id AS file, CAST(k AS INTEGER) AS line, CAST(greatest(coalesce(CASE WHEN k % 2 = 0 THEN k - 5 END, k), k) AS INTEGER) AS end_line FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)")
def diagnostics(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = T.table(spark, sf, "events").withColumn("k", k)
    return E.diagnostics(e.select(F.col("event_type").alias("code"), F.when(F.col("event_type") == "error", "error").alias("severity"), F.when(F.col("k") % 3 == 0, " ").otherwise(text("m", "{k}")).alias("message"), text("f", "{user_id}").alias("file"), F.col("k").alias("line"), F.when(F.col("k") % 2 == 0, F.col("k") - 5).alias("end_line")))


@query(H(", x AS (SELECT node_key AS key FROM nodes WHERE kind = 'package'), s AS (SELECT node_key FROM nodes WHERE kind = 'file' AND starts_with(qualified_name, 's/')) SELECT key, 'repeated node_key' AS fault FROM x UNION ALL SELECT node_key, 'unknown kind' FROM s UNION ALL SELECT edge_key, 'unknown relation' FROM edges WHERE relation = 'tests' UNION ALL SELECT edge_key, 'dangling' FROM edges WHERE relation <> 'contains' AND dst IN (SELECT node_key FROM nodes WHERE kind = 'function')"))
def contract_faults(spark, sf):
    """Packages come twice, suppliers have an unknown kind, tests an unknown relation, functions are missing; `contains` stays."""
    n, e = graph(spark, sf, form="plain")[0], model.passing(graph(spark, sf, form="named")[1]).withColumn("edge_key", F.struct("src", "relation", "dst"))
    bad = n.where("kind <> 'function'").withColumn("kind", F.when(F.startswith("qualified_name", F.lit("s/")), "thing").otherwise(F.col("kind")))
    return E.contract_faults(bad.unionByName(n.where("kind = 'package'")), e.withColumn("relation", F.when(F.col("relation") == "tests", "checks").otherwise(F.col("relation"))), model.key_of_plain, lambda k: model.edge_key_of_plain(*(f"key.{c}" for c in ("src", "relation", "dst"))))


# resolution: part p is a module of its brand; module m<n> re-exports all of m<n / 2>, names are sizes

_MODULES = "d AS (SELECT 'm' || p_partkey % 64 AS module, 'n' || p_size AS name, 'p' || min(p_partkey) AS symbol FROM part GROUP BY 1, 2), r AS (SELECT 'm' || i AS module, 'm' || i // 2 AS source FROM range(1, 64) t(i)), e AS (SELECT module, name, symbol, 0 AS n_hops FROM d UNION ALL SELECT r.module, e.name, e.symbol, n_hops + 1 FROM e JOIN r ON e.module = r.source), x AS (SELECT module, name, min(n_hops) AS n_hops, arg_min(symbol, (n_hops, symbol)) AS symbol FROM e GROUP BY 1, 2)"


def declared(spark, sf):
    part = T.table(spark, sf, "part")
    return part.groupBy(F.concat(F.lit("m"), F.col(KEY) % 64).alias("module"), text("n", "{p_size}").alias("name")).agg(F.concat(F.lit("p"), F.min(KEY)).alias("symbol"))


def exported(spark, sf):
    again = spark.range(1, 64).select(F.concat(F.lit("m"), "id").alias("module"), F.lit("*").alias("name"), F.concat(F.lit("m"), F.floor(F.col("id") / 2)).alias("source"), F.lit("*").alias("source_name"))
    return N.resolve_exports(declared(spark, sf), again)


@query(f"WITH RECURSIVE {_MODULES} SELECT module, name, symbol, n_hops FROM x")
def resolved_exports(spark, sf):
    return exported(spark, sf)


_IMPORTS = "i AS (SELECT DISTINCT 'f' || o_custkey AS file, 'l' || o_orderkey % 7 AS local, 'm' || o_orderkey % 80 AS module, 'n' || o_custkey % 60 AS name FROM orders)"


def imported(spark, sf):
    o = T.table(spark, sf, "orders").select(text("f", "{o_custkey}").alias("file"), F.concat(F.lit("l"), F.col("o_orderkey") % 7).alias("local"), F.concat(F.lit("m"), F.col("o_orderkey") % 80).alias("module"), F.concat(F.lit("n"), F.col("o_custkey") % 60).alias("name")).distinct()
    return N.resolve_imports(o, exported(spark, sf))


@query(f"WITH RECURSIVE {_MODULES}, {_IMPORTS} SELECT file, local, module, name, symbol, CASE WHEN symbol IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution FROM i LEFT JOIN x USING (module, name)")
def resolved_imports(spark, sf):
    return imported(spark, sf)


_CALLS = "SELECT l_orderkey * 10 + l_linenumber AS call, CASE WHEN l_linenumber = 3 THEN 'm' || l_suppkey % 64 ELSE 'f' || l_suppkey END AS file, CASE WHEN l_linenumber < 3 THEN 'l' || l_partkey % 9 ELSE 'n' || l_partkey % 55 END AS name FROM lineitem"


@query(f"WITH RECURSIVE {_MODULES}, {_IMPORTS}, b AS (SELECT file, local AS name, min(symbol) AS imported FROM i JOIN x USING (module, name) GROUP BY 1, 2), g AS (SELECT name, count(DISTINCT symbol) AS n, min(symbol) AS only_ FROM d GROUP BY 1), c AS ({_CALLS}) SELECT call, c.file, c.name, coalesce(d.symbol, imported, CASE WHEN n = 1 THEN only_ END) AS symbol, CASE WHEN coalesce(d.symbol, imported) IS NOT NULL THEN 'resolved' WHEN n = 1 THEN 'partial' ELSE 'unresolved' END AS resolution, CASE WHEN d.symbol IS NOT NULL THEN 'file' WHEN imported IS NOT NULL THEN 'import' WHEN n = 1 THEN 'only' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS basis FROM c LEFT JOIN d ON d.module = c.file AND d.name = c.name LEFT JOIN b ON b.file = c.file AND b.name = c.name LEFT JOIN g ON g.name = c.name")
def resolved_calls(spark, sf):
    line = T.table(spark, sf, "lineitem")
    calls = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"), F.when(F.col("l_linenumber") == 3, F.concat(F.lit("m"), F.col("l_suppkey") % 64)).otherwise(text("f", "{l_suppkey}")).alias("file"), F.when(F.col("l_linenumber") < 3, F.concat(F.lit("l"), F.col("l_partkey") % 9)).otherwise(F.concat(F.lit("n"), F.col("l_partkey") % 55)).alias("name"))
    return N.resolve_calls(calls, declared(spark, sf), imported(spark, sf))


@query(f"WITH RECURSIVE {_MODULES}, k AS (SELECT 'p' || p_partkey AS symbol, CASE WHEN p_partkey % 3 = 0 THEN 'interface' ELSE 'class' END AS kind FROM part), c AS (SELECT 'p' || p_partkey AS src, 'm' || p_partkey % 64 AS file, CASE WHEN p_partkey % 2 = 0 THEN 'extends' ELSE 'implements' END AS keyword, 'n' || (p_size + 1) AS name FROM part), g AS (SELECT name, count(DISTINCT symbol) AS n, min(symbol) AS only_ FROM d GROUP BY 1), f AS (SELECT src, keyword, c.name AS target, coalesce(d.symbol, CASE WHEN n = 1 THEN only_ END) AS dst, CASE WHEN d.symbol IS NOT NULL THEN 'resolved' WHEN n = 1 THEN 'partial' ELSE 'unresolved' END AS resolution FROM c LEFT JOIN d ON d.module = c.file AND d.name = c.name LEFT JOIN g ON g.name = c.name) SELECT src, CASE WHEN a.kind = 'interface' THEN 'extends' WHEN b.kind = 'interface' THEN 'implements' ELSE keyword END AS relation, dst, target, resolution FROM f LEFT JOIN k a ON a.symbol = src LEFT JOIN k b ON b.symbol = dst")
def heritage(spark, sf):
    part = T.table(spark, sf, "part")
    clauses = part.select(F.concat(F.lit("m"), F.col(KEY) % 64).alias("file"), text("p", "{p_partkey}").alias("symbol"), F.when(F.col(KEY) % 2 == 0, "extends").otherwise("implements").alias("keyword"), F.concat(F.lit("n"), F.col("p_size") + 1).alias("name"))
    kinds = part.select(text("p", "{p_partkey}").alias("symbol"), F.when(F.col(KEY) % 3 == 0, "interface").otherwise("class").alias("kind"))
    return N.heritage(clauses, declared(spark, sf), kinds, spark.createDataFrame([], "file string, local string, module string, name string, symbol string, resolution string"))


@query("WITH t AS (SELECT 't' || o_orderkey AS test, 'covers part' || o_orderkey % 3000 || ' and part' || o_custkey AS title FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT DISTINCT 't' || l_orderkey AS test, 'p' || l_partkey AS symbol FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linenumber = 2), s AS (SELECT 'p' || p_partkey AS symbol, 'part' || p_partkey AS name FROM part) SELECT test, symbol, 'compiler' AS origin, 'certain' AS confidence FROM c UNION ALL SELECT DISTINCT test, symbol, 'heuristic', 'inferred' FROM t JOIN s ON list_contains(string_split(title, ' '), name) WHERE test NOT IN (SELECT test FROM c)")
def linked_tests(spark, sf):
    o = T.table(spark, sf, "orders").where("o_orderstatus = 'F'")
    tests = o.select(text("t", "{o_orderkey}").alias("test"), F.concat(F.lit("covers part"), F.col("o_orderkey") % 3000, F.lit(" and part"), "o_custkey").alias("title"))
    calls = T.table(spark, sf, "lineitem").where("l_linenumber = 2").select(text("t", "{l_orderkey}").alias("test"), text("p", "{l_partkey}").alias("symbol"))
    return N.linked_tests(tests, calls, T.table(spark, sf, "part").select(text("p", "{p_partkey}").alias("symbol"), text("part", "{p_partkey}").alias("display_name")))


# streams

def streamed(spark, sf, transform, mode: str):
    """A stream of the events, once through transform and read back."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    T.table(spark, sf, "events").repartitionByRange(4, "ts").write.parquet(f"{at}/in")
    out = transform(feeds.event_stream(spark, f"{at}/in", "event_id long, ts timestamp, user_id long, event_type string, value double, props string", 2))
    out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def streamed_events(spark, sf):
    """Each event comes twice and is kept once."""
    return streamed(spark, sf, lambda s: feeds.unique_events(s.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")), "3650 days"), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT 'k/' || (props->>'$.k') AS path, ['change', 'rename', 'rescan'][max(CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END)] AS kind, 0 AS generation FROM events GROUP BY 1")
def refresh_batches(spark, sf):
    """One micro-batch of all events."""
    at = f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}"
    T.table(spark, sf, "events").write.parquet(f"{at}/in")
    s = feeds.event_stream(spark, f"{at}/in", "event_id long, ts timestamp, user_id long, event_type string, value double, props string", 1 << 20)
    changes = s.select("event_id", F.concat(F.lit("k/"), F.get_json_object("props", "$.k")).alias("path"), F.expr("CASE event_type WHEN 'error' THEN 'rescan' WHEN 'click' THEN 'rename' ELSE 'change' END").alias("kind"))
    feeds.refresh_each(changes, lambda batch, generation: batch.withColumn("generation", F.lit(generation)).write.mode("overwrite").parquet(f"{at}/out/g{generation}"), f"{at}/state").awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(f"{at}/out")


# what is left of reading, comparing and budgeting

_ODD = ["a/./b.ts", "a/../b.ts", "../x", "/abs", "a//b/", "C:/x", "a/b/../../..", "a\\b", ""]
_CLEAN = ["a/b.ts", "b.ts", None, None, "a/b", None, None, "a/b", ""]


@query("SELECT p_partkey, " + "CASE CAST(p_partkey % 9 AS INTEGER) " + " ".join(f"WHEN {i} THEN " + ("NULL" if c is None else f"'{c}'") for i, c in enumerate(_CLEAN)) + " END AS path FROM part")
def normalized_paths(spark, sf):
    return T.table(spark, sf, "part").select(KEY, C.normalized(pick(_ODD)).alias("path"))


@query("WITH s AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'excluded' WHEN doc_id % 5 = 0 THEN 'ignored' END AS reason, CASE WHEN doc_id % 7 = 0 THEN 'build/' ELSE '' END || doc_id || '.tmp' || CASE WHEN doc_id % 5 <> 0 THEN 'x' ELSE '' END AS path FROM documents) SELECT reason, count(*) AS n, min(path) AS first_path FROM s WHERE reason IS NOT NULL GROUP BY 1")
def omission_evidence(spark, sf):
    d = T.table(spark, sf, "documents").select(F.concat(F.when(F.col("doc_id") % 7 == 0, "build/").otherwise(""), "doc_id", F.lit(".tmp"), F.when(F.col("doc_id") % 5 != 0, "x").otherwise("")).alias("path"), F.lit(b"").alias("content"), F.lit(0).alias("size"))
    return C.omissions(C.scan(d, ["*.tmp"]))


@query("WITH s AS (SELECT CASE WHEN doc_id % 13 = 0 THEN '../' ELSE '' END || 'f' || doc_id AS path, doc_id, sha256(text) AS h FROM documents) SELECT path, CASE WHEN r IN ('refresh_pending', 'content_changed') THEN 'stale' WHEN r = 'matches_snapshot' THEN 'fresh' ELSE 'unknown' END AS status, r AS reason FROM (SELECT path, CASE WHEN doc_id % 5 = 0 OR h IS NULL THEN 'not_in_snapshot' WHEN doc_id % 11 = 0 THEN 'refresh_pending' WHEN doc_id % 13 = 0 THEN 'outside_repository' WHEN doc_id % 7 = 0 THEN 'unreadable' WHEN doc_id % 4 = 0 THEN 'content_changed' ELSE 'matches_snapshot' END AS r FROM s)")
def freshness_reasons(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 13 == 0, "../").otherwise(""), F.lit("f"), "doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    live = d.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return store.freshness_reasons(d, d.where("doc_id % 5 <> 0"), live, d.where("doc_id % 11 = 0"))


@query(H(", gone AS (SELECT edge_key, src, dst FROM edges WHERE origin = 'heuristic'), kept AS (SELECT * FROM edges WHERE origin <> 'heuristic'), ends AS (SELECT src AS k FROM kept UNION SELECT dst FROM kept), loose AS (SELECT node_key, file FROM nodes WHERE kind IN ('method', 'test', 'function') AND node_key NOT IN (SELECT k FROM ends)), files AS (SELECT DISTINCT file FROM nodes WHERE file IS NOT NULL), stay AS (SELECT DISTINCT file FROM nodes WHERE node_key NOT IN (SELECT node_key FROM loose) AND file IS NOT NULL AND kind NOT IN ('file')) SELECT 'edge' AS what, count(*) AS n FROM gone UNION ALL SELECT 'node', count(*) FROM loose UNION ALL SELECT 'file', count(*) FROM files WHERE file NOT IN (SELECT file FROM stay)"))
def orphan_chain(spark, sf):
    """Claims of a heuristic have no membership, nor have orders and parts, nor files."""
    n, e = graph(spark, sf, form="plain")[0], model.passing(graph(spark, sf, form="named")[1])
    own = n.where("kind <> 'file'")
    edges_, nodes_, files_ = store.orphan_chain(e, own, n.where("file IS NOT NULL").select("file").distinct(), e.where("origin <> 'heuristic'"), own.where("kind NOT IN ('method', 'test', 'function')"), n.limit(0).select("file"), ["src", "relation", "dst"])
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(edges_, "edge").unionByName(count(nodes_, "node")).unionByName(count(files_, "file"))


@query("SELECT 'f' || doc_id AS key, 'missing replacement' AS fault FROM documents WHERE doc_id % 2 = 0 AND doc_id % 6 = 0 UNION ALL SELECT 'f' || doc_id, 'unexpected replacement' FROM documents WHERE doc_id % 2 = 1 AND doc_id % 50 = 1 UNION ALL SELECT 'f' || doc_id, 'language changed' FROM documents WHERE doc_id % 10 = 0 AND doc_id % 6 <> 0 UNION ALL SELECT 'd' || doc_id, 'declaration gone' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 8 = 0 UNION ALL SELECT 'n' || doc_id, 'declaration added' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 8 = 4")
def region_faults(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", text("f", "{doc_id}").alias("path"), F.lit("typescript").alias("language"))
    again = d.where("(doc_id % 2 = 0 AND doc_id % 6 <> 0) OR doc_id % 50 = 1").withColumn("language", F.when((F.col("doc_id") % 10 == 0), "python").otherwise(F.col("language")))
    nodes_ = d.select(text("d", "{doc_id}").alias("node_key"), F.lit("method").alias("kind"), F.col("path").alias("file"), "doc_id")
    new = nodes_.where("doc_id % 8 <> 0").unionByName(nodes_.where("doc_id % 8 = 4").withColumn("node_key", text("n", "{doc_id}")))
    return store.region_faults(d, again, d.where("doc_id % 2 = 0"), nodes_, new)


@query("SELECT event_type, median(value) AS median, count(value) AS n FROM events GROUP BY 1")
def median_value(spark, sf):
    from tessera.operators import aggregate

    return aggregate.median(T.table(spark, sf, "events"), ["event_type"], "value")


@query(H(", x AS (SELECT relation, CASE WHEN confidence = 'certain' THEN 'go' ELSE 'rust' END AS language, CASE WHEN origin = 'compiler' THEN 'semantic' ELSE 'structural' END AS capability, resolution AS derivation, origin, confidence, resolution, length(src) % 7 + 1 AS n_evidence FROM edges), b AS (SELECT relation, string_agg(origin || '/' || confidence || '/' || resolution || '=' || n, ',' ORDER BY origin || '/' || confidence || '/' || resolution || '=' || n) AS buckets FROM (SELECT relation, origin, confidence, resolution, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1) SELECT relation, count(*) AS n_edges, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, string_agg(DISTINCT capability, ',' ORDER BY capability) AS capabilities, string_agg(DISTINCT derivation, ',' ORDER BY derivation) AS derivations, CAST(sum(n_evidence) AS BIGINT) AS n_evidence_omitted, any_value(buckets) AS buckets FROM x JOIN b USING (relation) GROUP BY 1"))
def aggregate_provenance(spark, sf):
    from tessera.operators import aggregate

    e = graph(spark, sf)[1].select("*", F.when(F.col("confidence") == "certain", "go").otherwise("rust").alias("language"), F.when(F.col("origin") == "compiler", "semantic").otherwise("structural").alias("capability"), F.col("resolution").alias("derivation"), (F.length("src") % 7 + 1).alias("n_evidence"))
    return aggregate.aggregate_provenance(e, ["relation"])


_OWNED = ", p AS (SELECT node_key AS root, node_key AS node, 0 AS hop FROM nodes WHERE kind = 'package' UNION SELECT root, dst, hop + 1 FROM p JOIN edges ON src = node WHERE relation = 'contains'), m AS (SELECT node, min(hop) AS d FROM p GROUP BY 1), o AS (SELECT p.node, min(root) AS owner, count(*) AS n FROM p JOIN m ON p.node = m.node AND hop = d GROUP BY 1), owners AS (SELECT node AS node_key, owner FROM o WHERE n = 1)"


@query(H(_OWNED + " SELECT sha256('package-edge|' || a.owner || '|' || relation || '|' || b.owner) AS group_key, edge_key FROM edges JOIN owners a ON src = a.node_key JOIN owners b ON dst = b.node_key WHERE a.owner <> b.owner", recursive=True))
def package_edge_sources(spark, sf):
    from tessera.operators import project

    n, e = graph(spark, sf)
    return project.package_edge_sources(e, project.ownership(n, e))


@query(H(_OWNED + ", pk AS (SELECT node_key AS owner, CASE WHEN display_name < 'G' THEN sha256('region|project_root|early') ELSE sha256('region|package_containment|' || node_key) END AS region_key, CASE WHEN display_name < 'G' THEN 'Early' ELSE display_name END AS label, CASE WHEN display_name < 'G' THEN 'project_root' ELSE 'package_containment' END AS basis FROM nodes WHERE kind = 'package'), mem AS (SELECT node_key, region_key FROM owners JOIN pk USING (owner)), ent AS (SELECT region_key, count(*) AS n_entities, list(DISTINCT language) FILTER (language IS NOT NULL) AS own FROM nodes JOIN mem USING (node_key) GROUP BY 1), s AS (SELECT region_key, min(label) AS label, min(basis) AS basis, count(*) AS n_packages FROM pk GROUP BY 1), x AS MATERIALIZED (SELECT edges.*, a.region_key AS ra FROM edges JOIN mem a ON src = a.node_key), y AS MATERIALIZED (SELECT x.*, b.region_key AS rb FROM x JOIN mem b ON dst = b.node_key) SELECT region_key, label, basis, n_packages, coalesce(n_entities, 0) AS n_entities, array_to_string(list_sort(list_distinct(coalesce(own, []) || CASE WHEN basis = 'project_root' THEN ['go', 'SUPPLY'] ELSE [] END)), ',') AS languages, (SELECT count(*) FROM y WHERE ra = s.region_key AND ra <> rb) AS n_out, (SELECT count(*) FROM y WHERE rb = s.region_key AND ra <> rb) AS n_in, (SELECT count(*) FROM y WHERE ra = s.region_key AND ra = rb AND relation = 'contains') AS n_basis_edges FROM s LEFT JOIN ent USING (region_key)", recursive=True))
def region_projection(spark, sf):
    """Packages whose names come before G are one project."""
    from tessera.operators import project

    n, e = graph(spark, sf)
    early = n.where("kind = 'package' AND display_name < 'G'").select(F.col("node_key").alias("package"), F.lit("early").alias("project"), F.lit("Early").alias("label"), F.array(F.lit("go"), F.lit("SUPPLY")).alias("languages"))
    return project.region_projection(n, e, project.ownership(n, e), early)


@query("SELECT 'a' AS part, (SELECT count(*) FROM nation) AS total, 20 AS shown, (SELECT count(*) FROM nation) - 20 AS omitted, 105 AS next_cursor UNION ALL SELECT 'b', (SELECT count(*) FROM region), (SELECT count(*) FROM region), 0, 105 UNION ALL SELECT 'c', (SELECT count(*) FROM supplier), 75, (SELECT count(*) FROM supplier) - 75, 105")
def page_counts(spark, sf):
    """A page from the sixth row on, a hundred rows long, over three lists."""
    from tessera.operators import diff

    return diff.page_counts([("a", T.table(spark, sf, "nation")), ("b", T.table(spark, sf, "region")), ("c", T.table(spark, sf, "supplier"))], 5, 100)


@query(H(" SELECT 'no-five' AS rule, count(*) AS n_edges, min(edge_key) AS evidence, 'file:' || a.file AS src, 'file:' || b.file AS dst FROM edges JOIN nodes a ON src = a.node_key JOIN nodes b ON dst = b.node_key WHERE relation = 'imports' AND ends_with(a.file, '5') AND b.file = 's/5' GROUP BY a.file, b.file"))
def violation_evidence(spark, sf):
    n, e = graph(spark, sf)
    return R.violations(e, n, [{"id": "no-five", "from": "c/*5", "deny": ["s/5"], "severity": "error"}]).select("rule", "n_edges", "evidence", "src", "dst")


_W = "list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')"
_SCORED = f"""WITH h AS (SELECT p_partkey, p_name, p_type, len(w) AS len, len(list_filter(w, lambda x: starts_with(x, 're'))) AS f0, len(list_filter(w, lambda x: starts_with(x, 'wi'))) AS f1 FROM (SELECT *, {_W} AS w FROM part)),
t AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM h)
SELECT p_partkey, lower(p_name) = 're wi' AS exact, round(greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / mean)) + greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM h, t WHERE f0 > 0 AND f1 > 0 AND p_type = 'ECONOMY'"""


def part_index(spark, sf):
    from tessera.operators.search import PostingIndex

    return PostingIndex.build(T.table(spark, sf, "part"), KEY, ["p_name"], f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")


@query(f"SELECT *, (SELECT count(*) FROM ({_SCORED})) AS n_hits FROM ({_SCORED}) ORDER BY exact DESC, score DESC, p_partkey LIMIT 20")
def index_search(spark, sf):
    """Twenty hits of one type from the stored postings: the limit is the feature."""
    return part_index(spark, sf).search(T.table(spark, sf, "part"), "re wi", ["p_name"], F.col("p_type") == "ECONOMY", 20)


@query("SELECT p_partkey, 'missing' AS fault FROM (SELECT max(p_partkey) + 1 AS p_partkey FROM part) UNION ALL SELECT p_partkey, 'orphan' FROM part WHERE p_size = 7")
def index_repair(spark, sf):
    part = T.table(spark, sf, "part")
    return part_index(spark, sf).faults(part.where("p_size <> 7").select(KEY).union(part.agg(F.max(KEY) + 1)))


_FORCED = """, a AS (SELECT sha256('node|function|part:1') AS node), f AS (SELECT src AS node, relation, origin, confidence, resolution FROM edges, a WHERE dst = a.node AND (relation = 'calls' OR (relation = 'tests' AND confidence = 'certain'))),
l1 AS (SELECT node, max(CASE confidence WHEN 'certain' THEN 2 WHEN 'likely' THEN 1 ELSE 0 END) AS cr, max(CASE WHEN relation = 'calls' THEN CASE WHEN origin = 'compiler' AND confidence = 'certain' AND resolution = 'resolved' THEN 2 ELSE 1 END ELSE 2 END) AS pr, max(CASE WHEN relation = 'tests' THEN 1 ELSE 0 END) AS linked FROM f GROUP BY 1),
l2 AS (SELECT dst AS node, max(CASE confidence WHEN 'certain' THEN 2 WHEN 'likely' THEN 1 ELSE 0 END) AS cr FROM edges JOIN l1 ON src = l1.node WHERE relation = 'imports' GROUP BY 1), ty AS (SELECT node_key AS node FROM nodes WHERE kind = 'package' AND display_name IN ('ASIA', 'EUROPE')),
al AS (SELECT node, 1 AS hop, pr AS priority, cr AS confidence_rank, linked FROM l1 UNION ALL SELECT node, 2, 0, cr, 0 FROM l2 UNION ALL SELECT node, 1, 2, 0, 0 FROM ty), fi AS (SELECT dst, count(*) AS fan_in FROM edges WHERE relation IN ('imports', 'references', 'calls', 'implements', 'extends', 'routes_to') GROUP BY 1)"""


def forced_context(spark, sf):
    n, e = graph(spark, sf, form="plain")
    types = Q.mentions(spark.createDataFrame([("part:1", "make(a: ASIA, b: EUROPE[]): void")], "id string, signature string"), n.where("kind = 'package'"))
    out = G.context(e, n, plain(spark, ("function", "part:1")), 2, ("imports",), types.select(F.col("node_key").alias("node")))
    return out.withColumn("node", model.key_of_plain(F.col("node")))


@query(H(_FORCED + " SELECT al.node, hop, priority, coalesce(fan_in, 0) AS fan_in, confidence_rank, round(2.5 / (1 + hop) + ln(1 + coalesce(fan_in, 0)) + 1.5 * linked + 0.5 * CASE WHEN package = (SELECT package FROM nodes JOIN a ON node_key = a.node) THEN 1 ELSE 0 END, 6) AS score FROM al JOIN nodes ON node_key = al.node LEFT JOIN fi ON dst = al.node"))
def context_forced(spark, sf):
    """Imports alone are asked for: callers, certain tests and signature types come all the same."""
    return forced_context(spark, sf)


@query("SELECT 'd' || doc_id AS node, 'commit:' || lang AS evidence FROM documents WHERE doc_id % 3 = 0 AND lang IS NOT NULL UNION ALL SELECT 'd' || doc_id, 'e' || doc_id FROM documents WHERE doc_id % 3 <> 0")
def commit_evidence(spark, sf):
    d = T.table(spark, sf, "documents").where("doc_id % 3 <> 0 OR lang IS NOT NULL")
    own = F.when(F.col("doc_id") % 3 != 0, F.array(text("e", "{doc_id}"))).otherwise(F.array().cast("array<string>"))
    return d.select(text("d", "{doc_id}").alias("node"), F.array_join(views.evidence_or_commit(own, F.col("lang")), ",").alias("evidence"))


@query("WITH c AS (SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS name, CAST(length(p_name) * 4 AS BIGINT) AS signature FROM part), r AS (SELECT *, CAST(sum(name) OVER (ORDER BY p_partkey) AS BIGINT) AS running FROM c) SELECT 'name' AS level, p_partkey, running FROM r WHERE running <= 900 UNION ALL SELECT 'signature', p_partkey, CAST(sum(signature) OVER (ORDER BY p_partkey) AS BIGINT) FROM c WHERE p_partkey < 12")
def context_ladder(spark, sf):
    """All parts don't fit as signatures, so names fill the budget; the first dozen do."""
    part = T.table(spark, sf, "part").select(KEY, "p_name")
    costs = {"signature": (F.length("p_name") * 4).cast("long"), "name": F.length("p_name").cast("long")}
    level, rows = G.budget_ladder(part, [F.asc(KEY)], costs, 900)
    few, some = G.budget_ladder(part.where("p_partkey < 12"), [F.asc(KEY)], costs, 900)
    return rows.select(F.lit(level).alias("level"), KEY, "running").unionByName(some.select(F.lit(few).alias("level"), KEY, "running"))


@query("SELECT 'a' || p_size || '/f' || p_partkey || '.py' AS path, unnest([1, 2, 3, 4]) AS n, unnest(['proto/x.proto', CASE WHEN p_size = 7 THEN 'a7/h.h' END, 'tools/run.sh', NULL]) AS target, unnest(['resolved', CASE WHEN p_size = 7 THEN 'resolved' ELSE 'unresolved' END, 'resolved', 'unresolved']) AS resolution FROM part")
def path_references(spark, sf):
    """Generated bindings, includes and started scripts."""
    src = T.table(spark, sf, "part").select(F.concat(F.lit("a"), "p_size", F.lit("/f"), KEY, F.lit(".py")).alias("path"), F.lit('# generated-from: ../proto/x.proto\n#include "h.h"\nsubprocess.run(["bash", "tools/run.sh"])\n#include "../../out.h"').alias("t"))
    lines = X.lines_of(src, "path", "t")
    known = spark.createDataFrame([("proto/x.proto",), ("a7/h.h",), ("tools/run.sh",)], "path string")
    return N.path_references(lines, N.GENERATED_FROM, known).unionByName(N.path_references(lines, N.INCLUDE, known)).unionByName(N.path_references(lines, N.STARTED, known))
