"""Declarations from line patterns, references between languages, projects and diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.shared import in_passes, packed
from tessera.operators.review import unique_match
from tessera.operators.textlines import lines_of

_C_TYPES = [("type", r"^\s*(?:typedef\s+)?(?:struct|union|enum(?:\s+class)?)\s+(\w+)\s*(?:[:{]|$)"), ("type", r"^\s*typedef\s[^;{]*?\b(\w+)\s*;")]
_JAVA = r"(?:(?:public|protected|private|static|final|abstract|sealed|synchronized|native|default|strictfp)\s+)*"

# Our own patterns: what declares something in a line, per language; the first group is the name.
PATTERNS = {
    "protobuf": [("type", r"^\s*message\s+(\w+)"), ("interface", r"^\s*service\s+(\w+)"), ("method", r"^\s*rpc\s+(\w+)")],
    "terraform": [("type", r'^\s*resource\s+"[^"]+"\s+"([^"]+)"'), ("type", r'^\s*variable\s+"([^"]+)"')],
    "shell": [("function", r"^\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)\s*\{?")],
    "dockerfile": [("type", r"(?i)^FROM\s+\S+\s+AS\s+(\S+)")],
    "make": [("function", r"^([A-Za-z0-9_.-]+)\s*:(?!=)")],
    "cmake": [("function", r"(?i)^\s*add_(?:executable|library)\s*\(\s*(\S+?)[\s)]")],
    "python": [("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("type", r"^type\s+(\w+)")],
    "rust": [("function", r"^\s*(?:pub\s+)?fn\s+(\w+)"), ("type", r"^\s*(?:pub\s+)?(?:struct|enum)\s+(\w+)"), ("interface", r"^\s*(?:pub\s+)?trait\s+(\w+)")],
    # definitions at the line's start; a call or a prototype ends in a semicolon
    "c": [("function", r"^(?!typedef\b|return\b|else\b)[A-Za-z_][\w\s*]*[\s*](\w+)\s*\([^;]*$"), *_C_TYPES],
    "cpp": [("function", r"^(?!typedef\b|using\b|return\b|else\b)[A-Za-z_][\w\s*&:<>,]*[\s*&](?:\w+::)*(~?\w+)\s*\([^;]*$"), ("class", r"^\s*class\s+(\w+)\s*(?:final\s*)?(?:[:{]|$)"), *_C_TYPES],
    "java": [
        ("class", rf"^\s*{_JAVA}class\s+(\w+)"),
        ("interface", rf"^\s*{_JAVA}interface\s+(\w+)"),
        ("type", rf"^\s*{_JAVA}(?:enum|record)\s+(\w+)"),
        ("method", rf"^\s*(?!.*\brecord\s)(?!(?:return|new|else|throw|if|for|while|switch|catch|try|do)\b)(?=.*\)\s*(?:throws\s[\w., ]+)?\{{\s*$|(?:public|protected|private|abstract)\b){_JAVA}(?:<[^>]+>\s+)?(?:[\w.<>\[\],?]+\s+)?(\w+)\s*\([^=]*$"),
    ],
}


def declarations(files: DataFrame) -> DataFrame:
    """path, language, text -> path, n (line), kind, name of lines that declare something. The texts are cut into lines once, each line is asked its own language's patterns."""
    lines = files.select(F.struct("path", "language").alias("f"), "text")
    rows = lines_of(lines, "f", "text").select("f.path", "f.language", "n", "line")
    hit = lambda kind, pattern: F.when(F.col("line").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", pattern, 1).alias("name")))
    found = F.lit(None)
    for language, patterns in PATTERNS.items():
        found = F.when(F.col("language") == language, F.array_compact(F.array(*[hit(*x) for x in patterns]))).otherwise(found)
    return rows.where(F.col("language").isin(*PATTERNS)).select("path", "n", F.explode(found).alias("d")).select("path", "n", "d.kind", "d.name")


def register_plugin(spark: SparkSession, name: str, schema: str, plugin: type) -> None:
    """Makes a plug-in a table function of SQL: `SELECT ... FROM name(TABLE(files) PARTITION BY path)` over path and text.

    A plug-in's read(path, text) yields rows for a file, its end() for the path's files together; rows are
    dictionaries by the schema's names. What isn't in the schema is a fault, as is a missing column: the call fails
    and names it. The table may have more columns; they aren't seen. One object serves one path.
    """
    from pyspark.sql.functions import AnalyzeResult, udtf
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    names = set(kind.names)

    def checked(row: dict) -> tuple:
        if set(row) != names:
            raise ValueError(f"the plug-in's row has {sorted(row)}, declared are {sorted(names)}")
        return tuple(row[n] for n in kind.names)

    class Function:
        def __init__(self):
            self.plugin = plugin()

        @staticmethod
        def analyze(files):
            have = {} if files.dataType is None else {f.name for f in files.dataType}
            if not files.isTable or not {"path", "text"} <= set(have):
                raise ValueError("a plug-in takes a table with path and text")
            return AnalyzeResult(schema=kind)

        def eval(self, row):
            for out in self.plugin.read(row["path"], row["text"]):
                yield checked(out)

        def terminate(self):
            for out in self.plugin.end():
                yield checked(out)

    spark.udtf.register(name, udtf(Function))


def extracted(files: DataFrame, extractor: Callable[[str, str], Iterator[dict]], schema: str) -> DataFrame:
    """A plug-in over (path, text) of each file yields rows; it runs in the executors, batch by batch."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) for r in extractor(p, t or "")]
            yield pa.RecordBatch.from_pylist(found, kind)

    return files.select("path", "text").mapInArrow(run, schema)


def http_links(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """Calls (id, method, url) meet the only server (candidate, method, route) with their method and path; parameters (`:x`, `{x}`, `[x]`) are alike, and host and query of the url don't count."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^[a-z]+://[^/]*|[?#].*$", ""), r"/(?::\w+|\{[^}]*\}|\[[^\]]*\]|\d+)(?=/|$)", "/*"), r"(?<=.)/$", "")
    key = lambda method, c: F.concat_ws(" ", F.upper(method), plain(c))
    return unique_match(clients.withColumn("probe", key(F.col("method"), F.col("url"))), servers.select(key(F.col("method"), F.col("route")).alias("probe"), "candidate"), "probe").drop("probe")


def projects(files: DataFrame, manifests: dict[str, tuple[str, ...]]) -> DataFrame:
    """Manifest files found by name -> id (hash of path), root folder, manifest, sorted languages."""
    base = F.element_at(F.split("path", "/"), -1)
    table = files.sparkSession.createDataFrame([(k, sorted(set(v))) for k, v in manifests.items()], "manifest string, languages array<string>")
    rows = files.withColumn("manifest", base).join(F.broadcast(table), "manifest")  # a literal table
    root = F.regexp_replace("path", r"/?[^/]*$", "")
    return rows.select(model.identity("project", F.col("path")).alias("id"), F.when(root == "", ".").otherwise(root).alias("root"), "manifest", "languages")


#: Our own labels: how a claim was derived, by origin and relation.
DERIVATION = "CASE WHEN origin = 'compiler' THEN 'type_checked' WHEN origin = 'git' THEN 'mined' WHEN origin = 'doc' THEN 'documented' WHEN relation = 'contains' THEN 'structural' ELSE 'matched' END"


def with_provenance(edges: DataFrame, extractor: str, version: str) -> DataFrame:
    """extractor, version, derivation; unresolved edges get a reason."""
    return edges.select("*", F.lit(extractor).alias("extractor"), F.lit(version).alias("extractor_version"), F.expr(DERIVATION).alias("derivation"), F.when(F.col("resolution") == "unresolved", F.coalesce(F.col("unresolved_reason") if "unresolved_reason" in edges.columns else F.lit(None).cast("string"), F.lit("target not found"))).alias("reason"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """Missing severities are warnings, blank messages are their codes, a single line is its own end; equal rows are one."""
    last = F.coalesce("end_line", "line")
    return rows.select("code", F.coalesce("severity", F.lit("warning")).alias("severity"), F.when(F.coalesce(F.trim("message"), F.lit("")) == "", F.col("code")).otherwise(F.col("message")).alias("message"), "file", "line", F.greatest(last, F.col("line")).alias("end_line")).distinct()


def contract_faults(nodes: DataFrame, edges: DataFrame, node_digest: Callable[[Column], Column] = lambda k: k, edge_digest: Callable[[Column], Column] = lambda k: k) -> DataFrame:
    """What an extractor's rows break: repeated keys, unknown kinds or relations, loose ends, unresolved edges without a reason.

    Keys may be anything that tells nodes and edges apart; the digests make of `key` what is returned.
    """
    fault = lambda df, key, what: df.select(F.col(key).alias("key"), F.lit(what).alias("fault"))
    twice = lambda df, key: fault(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), key, f"repeated {key}")
    known = nodes.select("node_key")
    loose = packed(edges.select(F.explode(F.array("src", "dst")).alias("node_key")).distinct().join(known, "node_key", "left_anti"), "loose")
    passes = model.with_pass(edges, "edge_key")

    def broken(i: int) -> DataFrame:
        e = passes.where(F.col("pass") == i)
        at = e.join(loose.toDF("src"), "src", "left_semi").unionByName(e.join(loose.toDF("dst"), "dst", "left_semi")).unionByName(e.where("src IS NULL OR dst IS NULL"))
        out = twice(e, "edge_key").union(fault(e.where(~F.col("relation").isin(*model.RELATIONS)), "edge_key", "unknown relation")).union(fault(at, "edge_key", "dangling"))
        if "reason" in edges.columns:
            out = out.union(fault(e.where("resolution = 'unresolved' AND reason IS NULL"), "edge_key", "no reason"))
        return out.distinct()

    own = packed(twice(nodes, "node_key").union(fault(nodes.where(~F.col("kind").isin(*model.NODE_KINDS)), "node_key", "unknown kind")).distinct(), "node-faults")
    return own.select(node_digest(F.col("key")).alias("key"), "fault").union(in_passes(broken, "edge-faults").select(edge_digest(F.col("key")).alias("key"), "fault"))
