"""Project roots in the graph: each file under its deepest root's package, nested roots linked, broader owners' edges removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.shared import materialize


def _above(path: Column, least: int) -> Column:
    """Roots that may hold a path, by their depth: `.` and the path's prefixes of whole parts, without the last `least` parts."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - least, F.lit(0))), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))


def _deepest(rows: DataFrame, key: str, path: str, roots: DataFrame, least: int) -> DataFrame:
    """key and the deepest of roots (root) above its path; keys without one are left out."""
    asked = rows.select(key, F.posexplode(_above(F.col(path), least)).alias("depth", "root"))
    return asked.join(roots.select("root"), "root").groupBy(key).agg(F.max_by("root", "depth").alias("root"))


def project_packages(nodes: DataFrame, edges: DataFrame, projects: DataFrame, root_package: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The packages of roots, and the files' roots.

    nodes: node_key, kind, qualified_name, display_name, file. edges: edge_key, src, relation, dst.
    projects: project_id, root (`.` lies above every other), name, manifest, languages; several may share a root.

    packages: root, package, is_new, qualified_name, display_name, language, evidence. A root's package is the
    least package that bears the name of its first named project and directly contains files of this root only;
    else the package called `root_package` for `.`; else a new one. `root_package` takes `.` also where no root
    took that package. The evidence is the first project's manifest where it is a file, else the least file.
    homes: node_key, file, root of files below any root.
    """
    roots = projects.select("root").distinct()
    files = nodes.where("kind = 'file' AND file IS NOT NULL").select("node_key", "file")
    homes = materialize(files.join(_deepest(files, "node_key", "file", roots, 0), "node_key"), "homes")
    packages = nodes.where("kind = 'package'").select("node_key", "qualified_name", "display_name")
    held = edges.where("relation = 'contains'").select("src", F.col("dst").alias("node_key")).join(files, "node_key").join(homes.select("node_key", "root"), "node_key", "left")
    pure = held.groupBy("src").agg(F.min("root").alias("low"), F.max("root").alias("top"), F.bool_or(F.col("root").isNull()).alias("outside"))
    named = packages.select("node_key", F.explode(F.array_distinct(F.array("qualified_name", "display_name"))).alias("name")).join(pure, F.col("src") == F.col("node_key"), "left")
    first = projects.groupBy("root").agg(F.min(F.struct(F.col("name").isNull().alias("unnamed"), "project_id", "name")).alias("r"), F.min(F.struct("project_id", "manifest")).alias("f"), F.array_distinct(F.flatten(F.collect_set("languages"))).alias("languages"))
    first = first.select("root", F.col("r.name").alias("name"), F.col("f.manifest").alias("manifest"), F.when(F.size("languages") == 1, F.col("languages")[0]).alias("language"))
    clean = F.col("src").isNull() | (~F.col("outside") & (F.col("low") == F.col("root")) & (F.col("top") == F.col("root")))
    owner = first.join(named, "name").where(clean).groupBy("root").agg(F.min("node_key").alias("owner"))
    whole = packages.where(F.col("qualified_name") == (root_package or "")).agg(F.min("node_key").alias("whole"))  # one row
    least = homes.groupBy("root").agg(F.min("file").alias("least"))
    rows = first.join(owner, "root", "left").crossJoin(whole).join(least, "root", "left")
    rows = rows.join(files.select(F.col("file").alias("manifest"), F.lit(True).alias("kept")), "manifest", "left")
    made = F.concat(F.lit("project-root:"), F.col("root"))
    old = F.coalesce("owner", F.when(F.col("root") == ".", F.col("whole")))
    display = F.coalesce("name", F.when(F.col("root") == ".", "repository").otherwise(F.element_at(F.split("root", "/"), -1)))
    shown = lambda c: F.when(old.isNull(), c)  # noqa: E731  only of new packages
    out = rows.select("root", F.coalesce(old, model.node_key(F.lit("package"), made)).alias("package"), old.isNull().alias("is_new"), shown(made).alias("qualified_name"), shown(display).alias("display_name"), shown(F.col("language")).alias("language"), F.when(F.col("kept"), F.col("manifest")).otherwise(F.col("least")).alias("evidence"))
    out = materialize(out, "packages")
    free = whole.where("whole IS NOT NULL").join(out.select(F.col("package").alias("whole")), "whole", "left_anti").select(F.lit(".").alias("root"), "whole")
    out = out.join(free, "root", "full_outer").withColumn("is_new", F.col("whole").isNull() & F.col("is_new")).withColumn("package", F.coalesce("whole", "package")).drop("whole")
    return materialize(out.select("root", "package", "is_new", *[F.when(F.col("is_new"), F.col(c)).alias(c) for c in ("qualified_name", "display_name", "language")], "evidence"), "packages"), homes


def containment_changes(nodes: DataFrame, edges: DataFrame, packages: DataFrame, homes: DataFrame) -> DataFrame:
    """edge_key, src, dst, evidence, change of `contains` edges.

    removed: edges from a broader root's package to a file. added: from each root's package to the nearest root's
    below it; to the other packages that contain one of its files, else to the file itself unless it has it.
    A package that several roots took counts as the broadest one's.
    """
    depth = F.when(F.col("root") == ".", 0).otherwise(F.size(F.split("root", "/")))
    taken = packages.groupBy(F.col("package").alias("src")).agg(F.max_by("root", F.struct(-depth, "root")).alias("taken"))
    kinds = nodes.where("kind = 'package'").select(F.col("node_key").alias("src"))
    have = edges.where("relation = 'contains'").select("edge_key", "src", "dst")
    held = have.join(kinds, "src").join(homes.select(F.col("node_key").alias("dst"), "root"), "dst").join(taken, "src", "left")
    broader = (F.col("taken") != F.col("root")) & ((F.col("taken") == ".") | F.startswith("root", F.concat("taken", F.lit("/"))))
    held = materialize(held.select("edge_key", "src", "dst", "root", "taken", F.coalesce(broader, F.lit(False)).alias("broader")), "held")
    removed = held.where("broader").select("edge_key", "src", "dst", F.lit(None).cast("string").alias("evidence"), F.lit("removed").alias("change"))
    to = packages.select("root", "package", "evidence")
    owned = held.where("NOT broader").join(to, "root").select("dst", "src", "package", "evidence", F.col("taken").isNull().alias("structural"))
    by_owner = owned.where("structural").select(F.col("package").alias("src"), F.col("src").alias("dst"), "evidence")
    done = owned.groupBy("dst").agg(F.bool_or(F.col("structural") | (F.col("src") == F.col("package"))).alias("done")).where("done").select(F.col("dst").alias("node_key"))
    direct = homes.join(done, "node_key", "left_anti").join(to, "root").select(F.col("package").alias("src"), F.col("node_key").alias("dst"), "evidence")
    inner = packages.where("root <> '.'").select(F.col("root").alias("child"))
    parent = _deepest(inner, "child", "child", packages, 1)
    nested = parent.join(packages.select(F.col("root").alias("child"), F.col("package").alias("dst"), "evidence"), "child").join(packages.select("root", F.col("package").alias("src")), "root").where("src <> dst").select("src", "dst", "evidence")
    added = by_owner.unionByName(direct).unionByName(nested).groupBy("src", "dst").agg(F.min("evidence").alias("evidence")).join(have.select("src", "dst"), ["src", "dst"], "left_anti")
    return removed.unionByName(added.select(model.edge_key(F.col("src"), F.lit("contains"), F.col("dst")).alias("edge_key"), "src", "dst", "evidence", F.lit("added").alias("change")))


def apply_changes(nodes: DataFrame, edges: DataFrame, packages: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the new packages and edges with the changes: heuristic, certain, resolved. Other columns are null there."""
    new = packages.where("is_new").select(F.col("package").alias("node_key"), F.lit("package").alias("kind"), "qualified_name", "display_name", "language")
    left = edges.join(changes.where("change = 'removed'").select("edge_key"), "edge_key", "left_anti")
    more = changes.where("change = 'added'").select("edge_key", "src", F.lit("contains").alias("relation"), "dst", F.lit("heuristic").alias("origin"), F.lit("certain").alias("confidence"), F.lit("resolved").alias("resolution"))
    fit = lambda df, like: df.select(*[c for c in df.columns if c in like.columns])
    return nodes.unionByName(fit(new, nodes), allowMissingColumns=True), left.unionByName(fit(more, edges), allowMissingColumns=True)
