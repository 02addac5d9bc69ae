"""Sources: captured trees, commit logs, rule files and agent events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages in order of precedence, with their file names, extensions and patterns of generated paths.
BY_NAME = {"dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "shell", "go.mod": "toml", "go.work": "toml", "cmakelists.txt": "cmake", ".gitignore": "repository-config", "yarn.lock": "repository-config"}
EXTENSIONS = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py pyi", "cpp": "cc cpp cxx hh hpp hxx", "c": "c h", "go": "go", "rust": "rs", "java": "java", "protobuf": "proto",
    "terraform": "tf tfvars", "yaml": "yaml yml", "markdown": "md markdown", "json": "json jsonc", "shell": "sh bash", "toml": "toml", "cmake": "cmake",
}
BY_EXTENSION = {e: name for name, own in EXTENSIONS.items() for e in own.split()}
BY_INTERPRETER = {"javascript": r"^#!.*\bnode\b", "python": r"^#!.*\bpython(?:3(?:\.\d+)?)?\b", "shell": r"^#!.*\b(?:ba|z|k)?sh\b"}
GENERATED = {
    "typescript": r"\.d\.(?:ts|mts|cts)$", "javascript": r"\.min\.js$", "python": r"\bsite-packages\b", "cpp": r"\b(?:cmake-build|generated)\b", "c": r"\b(?:cmake-build|generated)\b", "go": r"\.pb\.go$",
    "rust": r"\btarget\b", "java": r"\b(?:build|generated)\b", "terraform": r"\.terraform/", "json": r"package-lock\.json$",
}
EXCLUDED = ("node_modules", ".git", "dist", "build", "coverage", "target", "__pycache__")
MOST_BYTES = 5 << 20


def captured(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), content, size of every file, whatever the store."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").rpartition("/")[2]
    return df.select(F.regexp_replace("path", rf"^.*?/{base}/", "").alias("path"), "content", F.col("length").alias("size"))


def scan(files: DataFrame, ignored: list[str] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, reason (null: indexed), hash. Excluded folders, ignore rules (`dir/`, `*.suffix`, exact), large files and files with NUL are told apart."""
    parts = F.split("path", "/")
    inside = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*EXCLUDED))
    rule = F.lit(False)
    for r in ignored:
        if r.endswith("/"):
            rule = rule | F.startswith("path", F.lit(r)) | F.contains("path", F.lit(f"/{r}"))
        elif r.startswith("*"):
            rule = rule | F.endswith("path", F.lit(r[1:]))
        else:
            rule = rule | (F.col("path") == r)
    reason = F.when(inside, "excluded").when(rule, "ignored").when(F.col("size") > most_bytes, "too_large").when(F.contains("content", F.lit(b"\0")), "binary")
    return files.select("path", reason.alias("reason"), F.sha2("content", 256).alias("hash"))


def language(path, first_line):
    """By file name, then extension, both in any case, then the interpreter line; null without one."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    look = lambda table, key: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)
    bang = F.lit(None).cast("string")
    for name, pattern in reversed(BY_INTERPRETER.items()):
        bang = F.when(first_line.rlike(pattern), F.lit(name)).otherwise(bang)
    return F.coalesce(look(BY_NAME, base), look(BY_EXTENSION, F.regexp_extract(base, r"^.+\.([^.]+)$", 1)), bang)


def is_generated(path, lang):
    """Whether the path matches its language's pattern for generated files, in any case."""
    out = F.lit(False)
    for name, pattern in GENERATED.items():
        out = out | ((lang == name) & path.rlike(f"(?i){pattern}"))
    return F.coalesce(out, F.lit(False))


def folder_of(path):
    """A path without its last part; the slash stays."""
    return path.substr(F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)))


def nearest_manifest(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """path -> name of the manifest (folder, name) in the nearest folder above; manifests without a name are passed over. Each folder is looked up once, not each file."""
    rows = files.select("path").distinct().withColumn("in", folder_of(F.col("path")))
    parts = F.split("in", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    places = files.select(folder_of(F.col("path")).alias("in")).distinct().select("in", F.explode(above).alias("folder")).join(manifests.where("name IS NOT NULL"), "folder")
    nearest = places.groupBy("in").agg(F.max_by("name", F.length("folder")).alias("package"))
    return rows.join(nearest, "in").select("path", "package")


def commit_files(log: DataFrame) -> DataFrame:
    """`git log --name-only --format=commit:%H` text (one column text) -> sha, ordinal (0 newest), file."""
    blocks = log.select(F.posexplode(F.split("text", r"(?m)^commit:")).alias("o", "b")).where("b <> ''")
    lines = blocks.select((F.col("o") - 1).alias("ordinal"), F.split("b", r"\r?\n").alias("l"))
    return lines.select(F.col("l")[0].alias("sha"), "ordinal", F.explode(F.slice("l", 2, 1 << 30)).alias("file")).where("trim(file) <> ''")


#: What the driver's events stand for; our own choice.
ROLE = {"view": "read", "click": "planned", "purchase": "modified", "signup": "test_selected", "error": "interrupted"}


def agent_events(events: DataFrame) -> DataFrame:
    """event_id, ts, task, role, file of driver events."""
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.col("event_type"))
    return events.select("event_id", "ts", F.col("user_id").alias("task"), role.alias("role"), F.concat(F.lit("k/"), F.get_json_object("props", "$.k")).alias("file"))


def accept_events(events: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events whose file is a known target, and the rejected rest with a reason."""
    known = targets.select("file").distinct()
    reason = F.when(F.col("file").isNull(), "missing target").otherwise("unknown target")
    return events.join(known, "file", "left_semi"), events.join(known, "file", "left_anti").withColumn("reason", reason)


def normalized(path):
    """A relative path without `.`, empty and `..` parts, in POSIX form; null where it is absolute or leaves its root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    none = F.lit(None).cast("array<string>")
    step = lambda a, p: F.when(a.isNull(), none).when(p.isin("", "."), a).when(p != "..", F.concat(a, F.array(p))).when(F.size(a) == 0, none).otherwise(F.slice(a, F.lit(1), F.size(a) - 1))
    clean = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"^(?:/|\\|[A-Za-z]:)"), F.lit(None).cast("string")).otherwise(F.array_join(clean, "/"))


def omissions(scanned: DataFrame) -> DataFrame:
    """reason, n and the least path of what a scan left out: its evidence."""
    return scanned.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
