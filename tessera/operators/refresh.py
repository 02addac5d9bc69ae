"""What an incremental refresh must do: nothing, a region, or everything, and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.diff import key_diff
from tessera.operators.traverse import reach

SEMANTIC = ("typescript", "javascript")  # fixed values: languages a region can be proved for
CONFIGURATION = r"(^|/)(package\.json|tsconfig[^/]*\.json|[^/]*\.config\.[jt]s|pnpm-workspace\.yaml)$"


@dataclass(frozen=True)
class Decision:
    mode: str  # noop, regional or full
    reason: str
    region: DataFrame | None = None


def decide(before: DataFrame, now: DataFrame, imports: DataFrame, same_head: bool = True, same_analyzer: bool = True, hints: tuple[str, ...] = ()) -> Decision:
    """before, now: path, hash, language. imports: src file -> dst file. The region of a regional refresh is the changed files and all that import them."""
    if not same_head:
        return Decision("full", "head changed")
    if not same_analyzer:
        return Decision("full", "analyzer changed")
    if {"rename", "rescan"} & set(hints):
        return Decision("full", "rename or rescan")
    changed = key_diff(before, now, "path", ["hash"])
    facts = changed.join(now.select("path", "language"), "path", "left").agg(
        F.count("*").alias("n"), F.count_if(F.col("change") != "metadata_changed").alias("moved"), F.count_if(F.col("path").rlike(CONFIGURATION)).alias("config"),
        F.count_if(~F.coalesce(F.col("language").isin(*SEMANTIC), F.lit(False))).alias("other"),
    ).first()
    if not facts["n"]:
        return Decision("noop", "nothing changed")
    for count, why in (("moved", "files added or removed"), ("config", "configuration changed"), ("other", "language without regional proof")):
        if facts[count]:
            return Decision("full", why)
    back = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return Decision("regional", "proved", reach(changed.select(F.col("path").alias("node")), back).select(F.col("node").alias("path")))


def loop_states(events: DataFrame, by: str) -> DataFrame:
    """by, event_id, step, generation, phase, outcome after each event (by, ts, event_id, step) of a finished log: what streaming.timers.refresh_loop says of them as they come.

    A build is open at an event if a begin came after the last end before it, and current if no change came after
    that begin. Generations count changes and those ends (moved, conflict) that ask anew.
    """
    before = Window.partitionBy(by).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(by).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("step").isin("done", "moved", "conflict", "fail", "noop")
    at = F.row_number().over(Window.partitionBy(by).orderBy("ts", "event_id"))
    last = lambda test: F.coalesce(F.max(F.when(test, F.col("at"))).over(before), F.lit(0))
    rows = events.select(by, "ts", "event_id", "step").withColumn("at", at)
    rows = rows.select("*", last(F.col("step") == "begin").alias("begun"), last(ends).alias("ended"), last(F.col("step") == "change").alias("changed"))
    open_, current = F.col("begun") > F.col("ended"), F.col("changed") < F.col("begun")
    again = F.col("step").isin("moved", "conflict")
    outcome = F.when(F.col("step").isin("change", "begin"), None).when(~ends | ~open_, "ignored").when(F.col("step") == "fail", "failed").when(~current, "obsolete").when(again, "requeued").when(F.col("step") == "done", "published").otherwise("noop")
    rows = rows.withColumn("outcome", outcome)
    bump = (F.col("step") == "change") | F.coalesce(F.col("outcome") == "requeued", F.lit(False))
    phase = F.when(F.col("step") == "change", "dirty").when(F.col("step") == "begin", "refreshing").when(F.col("outcome").isin("obsolete", "requeued"), "dirty").when(F.col("outcome") == "failed", "failed").when(F.col("outcome").isin("published", "noop"), "idle")
    return rows.select(by, "event_id", "step", F.sum(bump.cast("long")).over(upto).alias("generation"), F.coalesce(F.last(phase, ignorenulls=True).over(upto), F.lit("idle")).alias("phase"), "outcome")
