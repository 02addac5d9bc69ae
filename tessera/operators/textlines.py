"""Line and pattern extractors: headings, links, diff hunks, document references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def html_headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, n (from 1), level and title of h1 to h6 elements in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), 0)
    rows = pages.select(key, F.posexplode(found).alias("n", "h"))
    return rows.select(key, (F.col("n") + 1).alias("n"), F.regexp_extract("h", r"(?i)<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace("h", r"(?s)<[^>]*>", ""), r"\s+", " ")).alias("title"))


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, target, and how often it is linked."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s+href="([^"]*)"'), 1)
    return pages.select(key, F.explode(found).alias("target")).groupBy(key, "target").agg(F.count("*").alias("n_links"))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (line), level, title and parent (line of the nearest earlier heading of a lower level, null without one)."""
    heads = lines_of(docs, key, text).where(F.col("line").rlike(r"^#{1,6}\s+\S"))
    heads = heads.select(key, "n", F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+\s+|\s+#*$", "")).alias("title"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.max(F.when(F.col("level") == k, F.col("n"))).over(w).alias(f"h{k}") for k in range(1, 6)]
    marked = heads.select("*", *earlier)
    # the last heading of each lower level, cut off by none: the latest of them is the parent
    parent = F.array_max(F.filter(F.array(*[F.when(F.col("level") > k, F.col(f"h{k}")) for k in range(1, 6)]), lambda x: x.isNotNull()))
    return marked.select(key, "n", "level", "title", parent.alias("parent"))


def backtick_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (line) and term of all `code` spans."""
    return lines_of(docs, key, text).select(key, "n", F.explode(F.regexp_extract_all("line", F.lit("`([^`]+)`"), 1)).alias("term"))


def diff_hunks(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """Unified diffs -> key, file and line range (new side; the old side where lines only go) of each hunk."""
    rows = lines_of(diffs, key, text)
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    name = lambda mark: F.last(F.when(F.col("line").rlike(rf"^{mark} "), F.regexp_extract("line", rf"^{mark} (?:[ab]/)?([^\t]*)", 1)), ignorenulls=True).over(w)
    rows = rows.select("*", name(r"\+\+\+").alias("new_file"), name("---").alias("old_file")).where(F.col("line").rlike(r"^@@ -\d+"))
    part = lambda g: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", g)
    number = lambda g, d: F.when(part(g) == "", F.lit(d)).otherwise(part(g).cast("int"))
    gone = (number(4, 1) == 0) | (F.col("new_file") == "/dev/null")
    start = F.when(gone, number(1, 1)).otherwise(number(3, 1))
    size = F.when(gone, number(2, 1)).otherwise(number(4, 1))
    return rows.select(key, "n", F.when(gone, F.col("old_file")).otherwise(F.col("new_file")).alias("file"), start.alias("h_start"), (start + F.greatest(size, F.lit(1)) - 1).alias("h_end"))


def doc_links(terms: DataFrame, symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """Terms that are a path link certainly; those that name exactly one symbol likely; the first link of a line stays."""
    by_path = terms.join(paths.select(F.col("path").alias("term"), F.col("node_key").alias("target")), "term").withColumn("confidence", F.lit("certain"))
    one = symbols.groupBy(F.col("display_name").alias("term")).agg(F.count("*").alias("c"), F.min("node_key").alias("target")).where("c = 1").drop("c")
    by_name = terms.join(paths.select(F.col("path").alias("term")), "term", "left_anti").join(one, "term").withColumn("confidence", F.lit("likely"))
    every = by_path.unionByName(by_name)
    keys = [c for c in terms.columns if c != "term"]
    return every.groupBy(*keys).agg(F.min(F.struct("confidence", "term", "target")).alias("b")).select(*keys, "b.*")


def next_route(path: Column) -> Column:
    """The route of a file-convention page or handler, null for other files."""
    at = F.regexp_extract(path, r"(?:^|/)app/(?:(.*)/)?(?:page|route)\.[jt]sx?$", 1)
    clean = F.regexp_replace(F.concat(F.lit("/"), at), r"/\([^)]*\)", "")
    return F.when(path.rlike(r"(?:^|/)app/(?:.*/)?(?:page|route)\.[jt]sx?$"), F.when(clean == "", "/").otherwise(clean))
