"""Resolution over extracted rows: imports through re-exports, calls, heritage and tests, by joins and bounded-size loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialize, partitions
from tessera.sources.captures import folder_of, normalized


def resolve_exports(declared: DataFrame, reexports: DataFrame) -> DataFrame:
    """What each module exports: module, name, symbol, n_hops.

    declared: module, name, symbol. reexports: module, name (`*`: all), source module, source_name. Names follow
    re-exports until nothing is new, cycles included; a module's own declaration hides what stars bring, and
    the nearest origin wins, then the least symbol.
    """
    rest = materialize(reexports.select("module", "name", "source", "source_name"), "reexports")
    own = declared.select("module", "name", "symbol").distinct().withColumn("n_hops", F.lit(0))
    seen = materialize(own.groupBy("module", "name").agg(F.min("symbol").alias("symbol"), F.min("n_hops").alias("n_hops")), "exports")
    front = seen
    while True:
        from_ = front.select(F.col("module").alias("source"), F.col("name").alias("found"), "symbol", "n_hops")
        via = rest.join(from_, "source").where((F.col("source_name") == F.col("found")) | (F.col("source_name") == "*"))
        new = via.select("module", F.when(F.col("name") == "*", F.col("found")).otherwise(F.col("name")).alias("name"), "symbol", F.col("n_hops") + 1)
        new = new.toDF("module", "name", "symbol", "n_hops").groupBy("module", "name").agg(F.min("symbol").alias("symbol"), F.min("n_hops").alias("n_hops"))
        front = materialize(new.join(seen.select("module", "name"), ["module", "name"], "left_anti"), "exports")
        if front.isEmpty():
            return seen
        seen = materialize(seen.unionByName(front), "exports")


def resolve_imports(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """imports (file, local, module, name) with the symbol their module exports under the name; null and unresolved without one."""
    rows = imports.join(exports.select("module", "name", "symbol"), ["module", "name"], "left")
    return rows.select("file", "local", "module", "name", "symbol", F.when(F.col("symbol").isNull(), "unresolved").otherwise("resolved").alias("resolution"))


def resolve_calls(calls: DataFrame, declared: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (call, file, name) -> symbol, resolution and basis.

    A declaration in the same file comes first, then what the file imports under the name, then the only
    declaration of the name anywhere, which is partial; several make it ambiguous and unresolved.
    declared: module, name, symbol. imports: as resolve_imports gives them.
    """
    local = declared.groupBy(F.col("module").alias("file"), "name").agg(F.min("symbol").alias("own"))
    brought = imports.where("symbol IS NOT NULL").groupBy("file", F.col("local").alias("name")).agg(F.min("symbol").alias("imported"))
    near = calls.join(local, ["file", "name"], "left").join(brought, ["file", "name"], "left")
    anywhere = declared.groupBy("name").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("only"))
    rows = near.join(anywhere, "name", "left")
    one = F.col("n") == 1
    symbol = F.coalesce("own", "imported", F.when(one, F.col("only")))
    basis = F.when(F.col("own").isNotNull(), "file").when(F.col("imported").isNotNull(), "import").when(one, "only").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    resolution = F.when(F.coalesce("own", "imported").isNotNull(), "resolved").when(one, "partial").otherwise("unresolved")
    return rows.select("call", "file", "name", symbol.alias("symbol"), resolution.alias("resolution"), basis.alias("basis"))


def heritage(clauses: DataFrame, declared: DataFrame, kinds: DataFrame, imports: DataFrame) -> DataFrame:
    """clauses (file, symbol, keyword `extends` or `implements`, name) -> src, relation, dst, resolution. A class that extends an interface implements it; an interface only extends."""
    asked = clauses.select(F.monotonically_increasing_id().alias("call"), "file", "name", F.col("symbol").alias("src"), "keyword")
    asked = materialize(asked, "heritage")  # numbers stand as long as the file does
    found = resolve_calls(asked.select("call", "file", "name"), declared, imports).select("call", "symbol", "resolution")
    rows = asked.join(found, "call").join(kinds.select(F.col("symbol").alias("src"), F.col("kind").alias("src_kind")), "src", "left").join(kinds.select("symbol", F.col("kind").alias("dst_kind")), "symbol", "left")
    relation = F.when(F.col("src_kind") == "interface", "extends").when(F.col("dst_kind") == "interface", "implements").otherwise(F.col("keyword"))
    return rows.select("src", relation.alias("relation"), F.col("symbol").alias("dst"), F.col("name").alias("target"), "resolution")


def linked_tests(tests: DataFrame, calls: DataFrame, symbols: DataFrame, often: int = 100_000) -> DataFrame:
    """test, symbol, origin, confidence: symbols that a test calls are certain; else the only symbol whose name its title names as a word is inferred.

    tests: test, title. calls: test, symbol. symbols: symbol, display_name. Rows are dealt out in a fixed number of
    parts: they compress so well that the optimizer would put too many of them into a task. A word in more than
    `often` titles meets its name by a broadcast of such words, which are few.
    """
    parts = partitions(tests.sparkSession)
    dealt = lambda df: df.select("test").repartition(parts, "test")  # noqa: E731  a join's right side, so that it isn't moved above the join
    certain = calls.join(dealt(tests), "test", "left_semi").select("test", "symbol").distinct()
    named = tests.join(dealt(calls), "test", "left_anti").select("test", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"[A-Za-z_$][\w$]*"), 0))).alias("probe"))
    named = materialize(named, "words")
    frequent = materialize(named.groupBy("probe").agg(F.count("*").alias("n")).where(F.col("n") > often).select("probe"), "frequent")
    names = symbols.groupBy(F.col("display_name").alias("probe")).agg(F.count("*").alias("n"), F.min("symbol").alias("symbol")).where("n = 1").select("probe", "symbol")
    if frequent.isEmpty():
        match = named.repartition(parts, "probe").join(names, "probe")
    else:
        frequent = F.broadcast(frequent)
        match = named.join(frequent, "probe", "left_anti").repartition(parts, "probe").join(names, "probe")
        match = match.unionByName(named.join(F.broadcast(names.join(frequent, "probe", "left_semi")), "probe"))
    by_name = match.select("test", "symbol").repartition(parts, "test").distinct()
    mark = lambda df, origin, confidence: df.select("test", "symbol", F.lit(origin).alias("origin"), F.lit(confidence).alias("confidence"))
    return mark(certain, "compiler", "certain").unionByName(mark(by_name, "heuristic", "inferred"))


def with_projects(files: DataFrame, projects: DataFrame) -> DataFrame:
    """files (path, language) with the project (root, languages) of the deepest root above that has the language; `.` is above everything, null without one. Each folder and language is looked up once, not each file."""
    rows = files.select("path", "language", folder_of(F.col("path")).alias("in"))
    parts = F.split("in", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    places = rows.select("in", "language").distinct().select("in", "language", F.posexplode(above).alias("depth", "root"))
    hit = places.join(projects.select("root", "languages"), "root").where(F.array_contains("languages", F.col("language")))
    best = hit.groupBy("in", "language").agg(F.max_by("root", "depth").alias("project"))
    return rows.join(best, ["in", "language"], "left").select("path", "language", "project")


EXPRESS = r"""\b(?:app|router)\.(get|post|put|patch|delete|all|use)\s*\(\s*(?:(['"`])((?:(?!\2).)*)\2|([^,)]+))\s*,\s*([\w.$]+)?"""


def express_routes(lines: DataFrame) -> DataFrame:
    """lines (path, n, line) -> method, route, handler and resolution of route registrations; a computed route is unresolved and has none."""
    hit = lines.where(F.col("line").rlike(EXPRESS))
    part = lambda g: F.regexp_extract("line", EXPRESS, g)
    literal = (part(2) != "") & ~((part(2) == "`") & F.contains(part(3), F.lit("${")))
    return hit.select("path", "n", F.upper(part(1)).alias("method"), F.when(literal, part(3)).alias("route"), F.when(part(5) != "", part(5)).alias("handler"), F.when(literal, "resolved").otherwise("unresolved").alias("resolution"))


def path_references(lines: DataFrame, pattern: str, files: DataFrame) -> DataFrame:
    """lines (path, n, line) whose pattern's first group is a path, relative to the file's folder or else to the root: path, n, target (a file of files) and resolution."""
    hit = lines.withColumn("asked", F.regexp_extract("line", pattern, 1)).where("asked <> ''")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    near, far = normalized(F.concat(folder, F.col("asked"))), normalized(F.col("asked"))
    rows = hit.select("path", "n", near.alias("near"), far.alias("far"))
    known = files.select("path").distinct()
    rows = rows.join(known.select(F.col("path").alias("near"), F.lit(True).alias("a")), "near", "left").join(known.select(F.col("path").alias("far"), F.lit(True).alias("b")), "far", "left")
    target = F.when(F.col("a"), F.col("near")).when(F.col("b"), F.col("far"))
    return rows.select("path", "n", target.alias("target"), F.when(target.isNull(), "unresolved").otherwise("resolved").alias("resolution"))


#: Our own patterns: markers of generated bindings, includes and started scripts.
GENERATED_FROM = r"(?i)\bgenerated-from:\s*([^\s]+)"
INCLUDE = r'^\s*#\s*include\s*"([^"]+)"'
STARTED = r"""\b(?:subprocess\.\w+|exec|spawn)\s*\(\s*\[?\s*["'](?:(?:python3?|node|bash|sh)["']\s*,\s*["'])?([\w./-]+\.(?:py|js|sh))["']"""
