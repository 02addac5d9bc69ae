"""Queries of lexers, key paths and running streams. Source texts are made from every line of every document, so what stands in comments and strings differs from file to file."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.shared import shared_dir
from tessera.operators import containment, digests, dispatch, extract, keypaths, refresh, reports, scopes, search, segments, store
from tessera.plans import catalog_sources  # noqa: F401  its SQL is asked for here
from tessera.plans.catalog import H, ORACLES, diffs_sql, graph, query
from tessera.sources import testdata as T
from tessera.streaming import feeds, timers

#: A class a line, by doc_id % 3. {i}: the line's number, {t}: the line in a comment, {q}: in a string. `more` follows where the line's length is even.
_PYTHON = ("class A{i}(Base):\n    # def no{i}(): {t}\n    def m(self, x=\"{q}\"):\n        return helper{h}(x)\n", "    class In:\n        def deep(self): pass\n", "\n")
_JAVA = ("class A{i} extends Base {\n  // void no{i}() { {t}\n  int m(int x) { String s = \"{q}\"; /* } */\n    return helper{h}(x); }\n", "  interface In {\n    void deep(); }\n", "}\n")
_RUST = ("struct A{i}; impl A{i} {\n  // fn no{i}() { {t}\n  fn m(&self) { let s = \"{q}\";\n    helper{h}(s); }\n", "  fn n(&self) { /* { */\n    self.m(); }\n", "}\n")
_FRAGMENTS = (("python", _PYTHON), ("java", _JAVA), ("rust", _RUST))


def _code_files(spark, sf):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = T.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), (F.col("doc_id") % 3).alias("k"), lines.alias("lines"))

    def filled(pattern: str, t, i):
        out = F.lit(pattern)
        for mark, value in (("{i}", i.cast("string")), ("{h}", (i % 3).cast("string")), ("{t}", t), ("{q}", F.translate(t, '\\"', ""))):
            out = F.replace(out, F.lit(mark), value)
        return out

    def text(parts):
        begin, more, end = parts
        return F.array_join(F.transform("lines", lambda t, i: F.concat(filled(begin, t, i), F.when(F.length(t) % 2 == 0, more).otherwise(""), F.lit(end))), "")

    chosen, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (language, parts) in enumerate(_FRAGMENTS):
        chosen, name = F.when(F.col("k") == n, text(parts)).otherwise(chosen), F.when(F.col("k") == n, language).otherwise(name)
    tail = F.when(F.col("k") == 0, "def helper0(x): pass\ndef helper1(x): pass\nclass helper1: pass\n").otherwise("")
    return docs.select("path", name.alias("language"), F.concat(chosen, tail).alias("text"))


# Lines in the text of a document: five or seven for each of its own.
_LINES = """WITH l AS (SELECT 'd' || doc_id AS path, doc_id % 3 AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
f AS (SELECT *, length(t) % 2 = 0 AS more, CAST(1 + sum(CASE WHEN length(t) % 2 = 0 THEN 7 ELSE 5 END) OVER (PARTITION BY path ORDER BY i) - CASE WHEN length(t) % 2 = 0 THEN 7 ELSE 5 END AS BIGINT) AS s FROM l),
e AS (SELECT path, CAST(max(s + CASE WHEN more THEN 7 ELSE 5 END) AS BIGINT) AS s FROM f WHERE k = 0 GROUP BY path)"""


@query(_LINES + """
SELECT path, CASE WHEN k = 2 THEN 'type' ELSE 'class' END AS kind, 'A' || i AS qualified, NULL AS holder, s AS first, CASE WHEN k = 2 THEN s WHEN k = 1 THEN s + CASE WHEN more THEN 6 ELSE 4 END ELSE s + CASE WHEN more THEN 5 ELSE 3 END END AS last FROM f
UNION ALL SELECT path, 'method', 'A' || i || '.m', CASE WHEN k < 2 THEN 'A' || i END, s + 2, s + 3 FROM f
UNION ALL SELECT path, CASE k WHEN 0 THEN 'class' WHEN 1 THEN 'interface' ELSE 'method' END, 'A' || i || CASE WHEN k < 2 THEN '.In' ELSE '.n' END, CASE WHEN k < 2 THEN 'A' || i END, s + 4, s + 5 FROM f WHERE more
UNION ALL SELECT path, 'method', 'A' || i || '.In.deep', 'A' || i || '.In', s + 5, s + 5 FROM f WHERE more AND k < 2
UNION ALL SELECT path, unnest(['function', 'function', 'class']), unnest(['helper0', 'helper1', 'helper1']), NULL, unnest([s, s + 1, s + 2]), unnest([s, s + 1, s + 2]) FROM e""")
def scoped_declarations(spark, sf):
    """Every line of a document is a class with members; the line itself stands in a comment and a string."""
    return scopes.read_scopes(_code_files(spark, sf)).where("what = 'declaration'").select("path", "kind", "qualified", "holder", "first", "last")


@query(_LINES + """
SELECT path, 'A' || i || '.m' AS caller, 'helper' || i % 3 AS name, s + 3 AS line, CASE WHEN k = 0 AND i % 3 = 0 THEN 'helper0' END AS target, CASE WHEN k = 0 AND i % 3 = 0 THEN NULL WHEN k = 0 AND i % 3 = 1 THEN 'ambiguous-local-structural-target' ELSE 'no-local-structural-target' END AS reason FROM f
UNION ALL SELECT path, 'A' || i || '.n', 'm', s + 5, CASE WHEN n = 1 THEN 'A' || i || '.m' END, CASE WHEN n > 1 THEN 'ambiguous-local-structural-target' END FROM f JOIN (SELECT path, count(*) AS n FROM f GROUP BY path) USING (path) WHERE more AND k = 2""")
def scoped_calls(spark, sf):
    """Calls with the one declaration of their name in the file, else why there is none."""
    return scopes.local_calls(scopes.read_scopes(_code_files(spark, sf)))


_CONFIG = "l AS (SELECT doc_id, doc_id % 3 AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents)"


@query(f"""WITH {_CONFIG}
SELECT 'd' || doc_id AS path, 'id' AS key, CAST(doc_id AS VARCHAR) AS value, CAST(2 AS BIGINT) AS line FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'd' || doc_id, 'meta.lang', coalesce(lang, ''), 3 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'd' || doc_id, 'meta.source', coalesce(source, ''), 3 FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'd' || doc_id, 'lines.' || i, t, 4 FROM l WHERE k = 0
UNION ALL SELECT 'd' || doc_id, 'items.' || i || '.text', t, 2 * i + 2 FROM l WHERE k = 1 UNION ALL SELECT 'd' || doc_id, 'items.' || i || '.n', CAST(i AS VARCHAR), 2 * i + 3 FROM l WHERE k = 1
UNION ALL SELECT 'd' || doc_id, 'doc.' || '"d ' || doc_id || '".l' || i, replace(t, '''', ''), i + 2 FROM l WHERE k = 2""")
def config_keys(spark, sf):
    """Key paths of a JSON, YAML or TOML text a document, whose values are its lines."""
    lines, id_ = F.split(F.coalesce("text", F.lit("")), "\n"), F.col("doc_id").cast("string")
    meta = F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    as_json = F.concat(F.lit('{\n"id": '), id_, F.lit(',\n"meta": '), F.to_json(meta), F.lit(',\n"lines": '), F.to_json(lines), F.lit("}\n"))
    as_yaml = F.concat(F.lit("items:\n"), F.array_join(F.transform(lines, lambda t, i: F.concat(F.lit("- text: '"), F.replace(t, F.lit("'"), F.lit("''")), F.lit("'\n  n: "), i.cast("string"), F.lit("  # a 'number'\n"))), ""))
    as_toml = F.concat(F.lit('[doc."d '), id_, F.lit('"]\n'), F.array_join(F.transform(lines, lambda t, i: F.concat(F.lit("l"), i.cast("string"), F.lit(" = '"), F.replace(t, F.lit("'"), F.lit("")), F.lit("' # x\n"))), ""))
    k = F.col("doc_id") % 3
    files = T.table(spark, sf, "documents").select(F.concat(F.lit("d"), id_).alias("path"), F.when(k == 0, "json").when(k == 1, "yaml").otherwise("toml").alias("language"), F.when(k == 0, as_json).when(k == 1, as_yaml).otherwise(as_toml).alias("text"))
    return keypaths.key_paths(files)


_STEPS = ("change", "change", "begin", "begin", "done", "moved", "conflict", "fail", "noop")
_ENDS = "step IN ('done', 'moved', 'conflict', 'fail', 'noop')"


@query(f"""WITH e AS (SELECT user_id, event_id, ts, {list(_STEPS)}[CAST(props->>'$.k' AS BIGINT) % 9 + 1] AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
b AS (SELECT *, coalesce(max(CASE WHEN step = 'begin' THEN pos END) OVER w, 0) AS begun, coalesce(max(CASE WHEN {_ENDS} THEN pos END) OVER w, 0) AS ended, coalesce(max(CASE WHEN step = 'change' THEN pos END) OVER w, 0) AS changed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, CASE WHEN step IN ('change', 'begin') THEN NULL WHEN begun <= ended THEN 'ignored' WHEN step = 'fail' THEN 'failed' WHEN changed > begun THEN 'obsolete' WHEN step IN ('moved', 'conflict') THEN 'requeued' WHEN step = 'done' THEN 'published' ELSE 'noop' END AS outcome FROM b)
SELECT user_id, event_id, step, CAST(sum(CASE WHEN step = 'change' OR outcome = 'requeued' THEN 1 ELSE 0 END) OVER u AS BIGINT) AS generation,
  coalesce(last_value(CASE WHEN step = 'change' OR outcome IN ('obsolete', 'requeued') THEN 'dirty' WHEN step = 'begin' THEN 'refreshing' WHEN outcome = 'failed' THEN 'failed' WHEN outcome IN ('published', 'noop') THEN 'idle' END IGNORE NULLS) OVER u, 'idle') AS phase, outcome
FROM o WINDOW u AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def refresh_loop_states(spark, sf):
    """Generation, phase and outcome after each event of a refresh loop."""
    step = F.get(F.array(*[F.lit(s) for s in _STEPS]), (F.get_json_object("props", "$.k").cast("long") % 9).cast("int"))
    return refresh.loop_states(T.table(spark, sf, "events").select("user_id", "event_id", "ts", step.alias("step")), "user_id")


@query("WITH b AS (" + ORACLES["debounce_batches"] + """) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start) AS generation, start, "end", n_events FROM b WHERE least("end" + INTERVAL 12 HOUR, start + INTERVAL 48 HOUR) < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def debounce_stream(spark, sf):
    """The events as a stream: batches that the watermark has closed, from keyed state with timers. Each event comes twice and counts once."""
    own = spark.newSession()  # for the state store's setting
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    at = f"{shared_dir(spark)}/debounce-{uuid.uuid4().hex}"
    kind = F.expr("CASE event_type WHEN 'error' THEN 'rescan' WHEN 'click' THEN 'rename' ELSE 'change' END")
    rows = T.table(spark, sf, "events").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").alias("path"), kind.alias("kind"))
    rows.union(rows).write.parquet(f"{at}/in")
    stream = feeds.event_stream(own, f"{at}/in", "event_id long, ts timestamp, user_id long, path string, kind string", 1 << 20)
    batches = timers.debounced(stream, "user_id", 12 * 3600 * 1_000_000, 48 * 3600 * 1_000_000, "1 hour")
    q = batches.drop("changes").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("user_id long, generation long, start timestamp, end timestamp, n_events long").parquet(f"{at}/out")


# digests, comparisons of graphs, folding

_ROW = "sha256(to_json(struct_pack(confidence := confidence, dst := dst, edge_key := edge_key, origin := origin, relation := relation, resolution := resolution, src := src)))"


@query(H(f""", r AS (SELECT substr(edge_key, 1, 2) AS prefix, edge_key || ' ' || {_ROW} || ' 1' AS line FROM edges),
l2 AS (SELECT prefix, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM r GROUP BY prefix),
l1 AS (SELECT substr(prefix, 1, 1) AS prefix, sha256(string_agg(digest, chr(10) ORDER BY prefix)) AS digest, sum(n) AS n FROM l2 GROUP BY substr(l2.prefix, 1, 1)),
l0 AS (SELECT '' AS prefix, sha256(string_agg(digest, chr(10) ORDER BY prefix)) AS digest, sum(n) AS n FROM l1)
SELECT prefix, digest, CAST(n AS BIGINT) AS n FROM (FROM l2 UNION ALL FROM l1 UNION ALL FROM l0)"""))
def content_digests(spark, sf):
    """The digest tree of the edges, by canonical JSON."""
    return digests.digest_tree(graph(spark, sf)[1], "edge_key", digits=2)


_NODE_STATE = ["display_name", "kind", "language", "package"]


@query(diffs_sql("""SELECT 'node' AS part, coalesce(nb.node_key, nh.node_key) AS key, CASE WHEN nb.node_key IS NULL THEN 'added' WHEN nh.node_key IS NULL THEN 'removed' ELSE 'metadata_changed' END AS change, NULL AS src, NULL AS relation, NULL AS dst, NULL AS before_origin, NULL AS before_confidence, NULL AS before_resolution, NULL AS after_origin, NULL AS after_confidence, NULL AS after_resolution
FROM nb FULL JOIN nh ON nb.node_key = nh.node_key WHERE nb.node_key IS NULL OR nh.node_key IS NULL OR (nb.display_name, nb.kind, nb.language, nb.package) IS DISTINCT FROM (nh.display_name, nh.kind, nh.language, nh.package)
UNION ALL SELECT 'edge', coalesce(b.edge_key, h.edge_key), CASE WHEN b.edge_key IS NULL THEN 'added' WHEN h.edge_key IS NULL THEN 'removed' ELSE 'changed' END, coalesce(b.src, h.src), coalesce(b.relation, h.relation), coalesce(b.dst, h.dst), b.origin, b.confidence, b.resolution, h.origin, h.confidence, h.resolution
FROM b FULL JOIN h ON b.edge_key = h.edge_key WHERE b.edge_key IS NULL OR h.edge_key IS NULL OR (b.origin, b.confidence, b.resolution) IS DISTINCT FROM (h.origin, h.confidence, h.resolution)"""))
def live_graph_diff(spark, sf):
    """The served base against the graph as the tables now give it, nodes and edges."""
    return digests.named_graph_diff(graph(spark, sf, T.BASE, "named"), (T.nodes(spark, sf), T.named_edges(spark, sf)), _NODE_STATE)


@query(ORACLES["edge_diff"])
def working_tree_edges(spark, sf):
    """The base is published, the live graph reconciled with it; the diff reads folders whose digests differ."""
    at = digests.NamedContentStore(spark, f"{shared_dir(spark)}/content-{uuid.uuid4().hex}")
    at.publish_content(*graph(spark, sf, T.BASE, "named"), None)
    return digests.working_tree_changes(at, graph(spark, sf, form="named"))[2]


_MARKED = "translate(coalesce(text, ''), 'aeiouncz', 'ắếịờủńćż')"


@query(rf"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, sha256(array_to_string(w, ' ')) AS words_sha256 FROM (SELECT doc_id, regexp_extract_all(lower(translate(strip_accents(coalesce(text, '')), 'ắếịờủńćż', 'aeiouncz')), '[\p{{L}}\p{{N}}]+') AS w FROM documents)")
def folded_words(spark, sf):
    """Every document written with Vietnamese and Polish letters has the words of the plain text."""
    words = search.words_of(F.expr(_MARKED))
    return T.table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("words_sha256"))


# index segments and plug-ins

@query(ORACLES["index_search"])
def index_repaired(spark, sf):
    """An index with missing, changed, repeated and foreign rows, after a repair and a merge, finds what a new one does: twenty hits, the limit is the feature."""
    part = T.table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    wrong = part.where("p_size <> 7").withColumn("p_name", F.when(F.col("p_size") == 3, F.concat("p_name", F.lit(" re wi"))).otherwise(F.col("p_name")))
    wrong = wrong.union(part.where("p_size = 9")).union(part.where("p_size = 5").withColumn("p_partkey", -F.col("p_partkey")))
    index = segments.SegmentedIndex.create(wrong, "p_partkey", ["p_name"], f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}")
    index.repair(part)
    index.merge()
    return index.search(part, "re wi", ["p_name"], F.col("p_type") == "ECONOMY", 20)


@query("SELECT 'k' || doc_id % 50 AS path, count(*) AS n_files, sum(len(string_split(coalesce(text, ''), chr(10)))) AS n_lines, CAST(max(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS longest FROM documents GROUP BY 1")
def plugin_table(spark, sf):
    """A plug-in as a table function, called from SQL: each path's rows come to one call in parts."""
    extract.register_plugin(spark, "text_sizes", _SIZES, TextSizes)
    T.table(spark, sf, "documents").select(F.concat(F.lit("k"), F.col("doc_id") % 50).alias("path"), "text").createOrReplaceTempView("plugin_files")
    return spark.sql("SELECT path, n_files, n_lines, longest FROM text_sizes(TABLE(plugin_files) PARTITION BY path)")


_SIZES = "path string, n_files long, n_lines long, longest long"


class TextSizes:
    """A plug-in that sums up the files of a path; it holds three numbers, whatever their number."""

    def __init__(self):
        self.path, self.files, self.lines, self.longest = None, 0, 0, 0

    def read(self, path, text):
        text = text or ""
        self.path, self.files, self.lines, self.longest = path, self.files + 1, self.lines + text.count("\n") + 1, max(self.longest, len(text.encode()))
        return ()

    def end(self):
        yield {"path": self.path, "n_files": self.files, "n_lines": self.lines, "longest": self.longest}


# Files of parts lie in 35 folders. Packages pk0 to pk10 hold a quarter of them whatever their folder, `repo` the rest; pk11 and pk12 are empty.
_TREE = """WITH f AS (SELECT 's' || p_size % 5 || '/b' || p_partkey % 7 || '/f' || p_partkey AS file, CASE WHEN p_partkey % 4 = 0 THEN 'pk' || p_partkey % 11 ELSE 'repo' END AS pk FROM part),
j AS (SELECT s_suppkey AS id, 's' || s_suppkey % 4 || CASE WHEN s_suppkey % 2 = 0 THEN '/b' || s_suppkey % 7 ELSE '' END AS root, CASE WHEN s_suppkey % 3 = 0 THEN 'pk' || s_suppkey % 13 END AS name FROM supplier UNION ALL SELECT -1, '.', 'none'),
h AS (SELECT file, pk, max_by(root, CASE WHEN root = '.' THEN 0 ELSE len(string_split(root, '/')) END) AS root FROM f JOIN (SELECT DISTINCT root FROM j) ON root = '.' OR starts_with(file, root || '/') GROUP BY file, pk),
u AS (SELECT root, arg_min(name, id) FILTER (name IS NOT NULL) AS name FROM j GROUP BY root), e AS (SELECT root, min(file) AS evidence FROM h GROUP BY root),
o AS (SELECT root, CASE WHEN name IN ('pk11', 'pk12') OR (name IN (SELECT pk FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.pk = u.name AND h.root <> u.root)) THEN name WHEN root = '.' THEN 'repo' END AS owner, name FROM u),
p AS (SELECT root, coalesce(owner, sha256('node|package|project-root:' || root)) AS package, owner IS NULL AS is_new, CASE WHEN owner IS NULL THEN coalesce(name, string_split(root, '/')[-1]) END AS display_name, evidence FROM o LEFT JOIN e USING (root)),
t AS (SELECT package, arg_min(root, CASE WHEN root = '.' THEN '0' ELSE len(string_split(root, '/')) || '' END) AS taken FROM p GROUP BY package)"""


def _tree(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    file = F.concat(F.lit("s"), size % 5, F.lit("/b"), key % 7, F.lit("/f"), key)
    parts = T.table(spark, sf, "part").select(file.alias("file"), F.when(key % 4 == 0, F.concat(F.lit("pk"), key % 11)).otherwise("repo").alias("src"))
    none = F.lit(None).cast("string")
    named = F.concat(F.lit("pk"), F.col("id").cast("string"))
    packages = spark.range(13).select(named.alias("node_key"), F.lit("package").alias("kind"), named.alias("qualified_name"), named.alias("display_name"), none.alias("file"))
    whole = spark.range(1).select(F.lit("repo").alias("node_key"), F.lit("package").alias("kind"), F.lit("repo").alias("qualified_name"), F.lit("repo").alias("display_name"), none.alias("file"))
    nodes = parts.select(F.col("file").alias("node_key"), F.lit("file").alias("kind"), F.col("file").alias("qualified_name"), F.col("file").alias("display_name"), "file").unionByName(packages).unionByName(whole)
    edges = parts.select(F.concat("src", F.lit(">"), "file").alias("edge_key"), "src", F.lit("contains").alias("relation"), F.col("file").alias("dst"))
    s = F.col("s_suppkey")
    root = F.concat(F.lit("s"), s % 4, F.when(s % 2 == 0, F.concat(F.lit("/b"), s % 7)).otherwise(""))
    projects = T.table(spark, sf, "supplier").select(s.cast("long").alias("project_id"), root.alias("root"), F.when(s % 3 == 0, F.concat(F.lit("pk"), s % 13)).alias("name"))
    projects = projects.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("project_id"), F.lit(".").alias("root"), F.lit("none").alias("name")))
    return nodes, edges, projects.select("*", none.alias("manifest"), F.array(F.lit("go")).alias("languages"))


@query(_TREE + " SELECT root, package, is_new, display_name, evidence FROM p")
def project_root_packages(spark, sf):
    """Each project root's package: a named one that holds no other root's file, the repository's, or a new one."""
    nodes, edges, projects = _tree(spark, sf)
    return containment.project_packages(nodes, edges, projects, "repo")[0].select("root", "package", "is_new", "display_name", "evidence")


@query(_TREE + """, c AS (SELECT file, pk, h.root, p.package, p.evidence, taken, taken IS NOT NULL AND taken <> h.root AND (taken = '.' OR starts_with(h.root, taken || '/')) AS broader FROM h JOIN p USING (root) LEFT JOIN t ON t.package = pk),
a AS (SELECT package AS src, CASE WHEN taken IS NULL THEN pk ELSE file END AS dst, evidence FROM c WHERE taken IS NULL OR broader OR (pk <> package AND taken IS NOT NULL)
  UNION SELECT (SELECT arg_max(q.package, CASE WHEN q.root = '.' THEN 0 ELSE len(string_split(q.root, '/')) END) FROM p AS q WHERE q.root <> p.root AND (q.root = '.' OR starts_with(p.root, q.root || '/'))), package, evidence FROM p WHERE root <> '.')
SELECT pk || '>' || file AS edge_key, pk AS src, file AS dst, NULL AS evidence, 'removed' AS change FROM c WHERE broader
UNION ALL SELECT sha256('edge|' || src || '|contains|' || dst), src, dst, min(evidence), 'added' FROM a WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM f WHERE f.pk = a.src AND f.file = a.dst) GROUP BY src, dst""")
def project_root_changes(spark, sf):
    """Edges from roots to files, packages and nested roots that are added, and the broader owners' that go."""
    nodes, edges, projects = _tree(spark, sf)
    return containment.containment_changes(nodes, edges, *containment.project_packages(nodes, edges, projects, "repo"))


@query("""WITH d AS (SELECT 'p' || p_partkey AS symbol, 'n' || p_partkey % 700 AS name, CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 3 END AS lo, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 3 + p_size % 2 ELSE 99 END AS hi FROM part WHERE p_partkey % 5 > 0
  UNION ALL SELECT 'p' || p_partkey, 'n' || p_partkey % 700, 3, 3 FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 > 0)
SELECT l_orderkey * 10 + l_linenumber AS call, 'c' || l_suppkey AS caller, 'n' || l_partkey % 900 AS name, l_linenumber % 5 AS n_args, CASE WHEN n = 1 THEN only_ END AS target, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN 'heuristic' END AS origin, CASE WHEN n = 1 THEN 'likely' END AS confidence, CASE WHEN n = 1 THEN 'partial' ELSE 'unresolved' END AS resolution
FROM lineitem LEFT JOIN (SELECT name, k, count(DISTINCT symbol) AS n, min(symbol) AS only_ FROM d JOIN (SELECT unnest(range(5)) AS k) ON lo IS NULL OR k BETWEEN lo AND hi GROUP BY name, k) AS x ON x.name = 'n' || l_partkey % 900 AND x.k = l_linenumber % 5""")
def calls_by_arity(spark, sf):
    """Every line calls a name with some arguments; parts are its overloaded candidates."""
    key = F.col("p_partkey")
    part = T.table(spark, sf, "part").withColumn("kind", F.get(F.array(*[F.lit(k) for k in ("class", "method", "function", "method", "function")]), (key % 5).cast("int")))
    own = part.select(F.concat(F.lit("p"), key).alias("symbol"), "kind", F.concat(F.lit("n"), key % 700).alias("name"), F.when(key % 9 > 0, key % 3).alias("min_args"), F.when(key % 4 > 0, key % 3 + F.col("p_size") % 2).alias("max_args"))
    more = part.where(key % 2 == 0).select(F.concat(F.lit("p"), key).alias("symbol"), "kind", F.concat(F.lit("n"), key % 700).alias("name"), F.lit(3).alias("min_args"), F.lit(3).alias("max_args"))
    calls = T.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"), F.concat(F.lit("c"), "l_suppkey").alias("caller"), F.concat(F.lit("n"), F.col("l_partkey") % 900).alias("name"), (F.col("l_linenumber") % 5).alias("n_args"))
    return dispatch.calls_by_arity(calls, own.unionByName(more))


@query("""WITH c AS (SELECT 'f' || o_custkey % 50 AS file, 'c' || o_orderkey % 97 AS caller, 'handlers[' || o_orderpriority || ']' AS label, CAST(o_orderkey % 300 AS BIGINT) AS line FROM orders)
SELECT sha256('file|' || file) AS src, 'contains' AS relation, sha256('node|unresolved|' || file || '::<unresolved ' || label || '>') AS dst, 'compiler' AS origin, 'certain' AS confidence, 'resolved' AS resolution, CAST(1 AS BIGINT) AS n_sites, min(line) AS line FROM c GROUP BY file, label
UNION ALL SELECT caller, 'calls', sha256('node|unresolved|' || file || '::<unresolved ' || label || '>'), 'heuristic', 'inferred', 'unresolved', count(*), min(line) FROM c GROUP BY caller, file, label""")
def computed_calls(spark, sf):
    """Every order is a call of a computed member: nodes that stand for what isn't known, with their edges."""
    o = T.table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("file"), F.concat(F.lit("c"), F.col("o_orderkey") % 97).alias("caller"), F.concat(F.lit("handlers["), "o_orderpriority", F.lit("]")).alias("label"), (F.col("o_orderkey") % 300).cast("long").alias("line"))
    return dispatch.unresolved_edges(o, dispatch.unresolved_nodes(o))


@query()
def layout_by_cells(spark, sf):
    """A group per order priority and one of all orders, linked to the customer's next order, after five rounds. Iterated sums of doubles have no SQL; tests hold them against all pairs."""
    key = F.col("o_orderkey")
    o = T.table(spark, sf, "orders").select(key.alias("node"), "o_custkey", F.explode(F.array(F.lit("all"), F.col("o_orderpriority"))).alias("level"))
    part = lambda at: F.conv(F.substring(F.sha2(F.col("node").cast("string"), 256), at, 8), 16, 10).cast("double") / float(1 << 32) * 200 - 100
    seeds = o.select("level", "node", part(1).alias("x"), part(9).alias("y"))
    after = F.lead("node").over(Window.partitionBy("level", "o_custkey").orderBy("node"))
    links = o.select("level", F.col("node").alias("a"), after.alias("b")).where("b IS NOT NULL")
    return reports.relax_groups(seeds, links, "level", rounds=5).select("level", "node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(H(""", k AS (SELECT *, relation <> 'imports' OR confidence = 'certain' AS stays FROM edges)
SELECT relation, count(*) FILTER (stays) AS n_edges, CAST(coalesce(sum(2) FILTER (stays AND relation = 'imports'), 0) + count(*) FILTER (stays AND relation <> 'imports') AS BIGINT) AS n_evidence FROM k GROUP BY relation HAVING count(*) FILTER (stays) > 0"""))
def region_replaced(spark, sf):
    """All supplier files come again, and of the imports whose evidence is in them the certain ones; every edge has its source as evidence, imports also their target's file."""
    n, e = graph(spark, sf, form="plain")[0], model.passing(graph(spark, sf, form="named")[1])
    own = n.where("language = 'SUPPLY'")
    key = ["src", "relation", "dst"]
    proof = lambda df: df.select(*key, "pass", F.concat(F.lit("of "), "src").alias("file")).unionByName(df.where("relation = 'imports'").join(own.select(F.col("node_key").alias("dst"), "file"), "dst").select(*key, "pass", "file"))
    again = e.where("relation = 'imports' AND confidence = 'certain'")
    per_relation = lambda rows: rows.groupBy("relation").agg(F.count("*").alias("n"))  # noqa: E731  every proof is of an edge
    _, edges, evidence = store.replace_region(n, e, proof(e), own, again, proof(again), own.select(F.col("file").alias("path")), key, per_relation)
    n_proofs = evidence.groupBy("relation").agg(F.sum("n").alias("n_evidence"))
    return edges.groupBy("relation").agg(F.count("*").alias("n_edges")).join(n_proofs, "relation")
