"""Keyed state with event-time timers: debounced batches and the refresh loop as running operators.

Events of a key may arrive late and more than once. They wait in the key's state, in order of time, until the
watermark says that nothing earlier can come; a timer wakes the key when its next decision is due, so a batch
closes though no further event of its key arrives. What has been decided is never changed: events from before
that point are dropped, as are repeated ones. State lives in the checkpoint, so a restarted query goes on where
it stopped. The rows of a key don't depend on how its events fall into micro-batches.

The session's state store must be RocksDB (`spark.sql.streaming.stateStore.providerClass`), as Spark asks for
processors with timers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: Stronger kinds of change win over weaker ones of the same path.
STRENGTH = {"change": 0, "rename": 1, "rescan": 2}


def stronger(a: str | None, b: str) -> str:
    return b if a is None or STRENGTH.get(b, 0) > STRENGTH.get(a, 0) else a


class Timed(StatefulProcessor):
    """A key's waiting events and a small machine, both kept as one value. A subclass says how to advance them."""

    fields: tuple[str, ...] = ()

    def __init__(self, by: str, columns: list[str]):
        self.by, self.columns = by, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "v STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self._load()
        known = {(e[0], e[1]) for e in kept["waiting"]}
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            for event in zip(at.tolist(), frame["event_id"].tolist(), *(frame[c].tolist() for c in self.fields), strict=True):
                if event[0] > kept["upto"] and event[:2] not in known:
                    known.add(event[:2])
                    kept["waiting"].append(event)
        kept["waiting"].sort(key=lambda e: tuple(e[:2]))
        yield from self._go_on(key, kept, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, self._load(), timerValues)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        return json.loads(self.kept.get()[0]) if self.kept.exists() else {"waiting": [], "upto": -(1 << 62), "machine": self.start()}

    def _go_on(self, key, kept: dict, timer_values) -> Iterator[pd.DataFrame]:
        out, due = self.advance(kept, timer_values.getCurrentWatermarkInMs() * 1000)
        self.kept.update((json.dumps(kept),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due // 1000 + 1)
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=self.columns)

    def start(self) -> dict:
        raise NotImplementedError

    def advance(self, kept: dict, watermark: int) -> tuple[list[tuple], int | None]:
        """Rows that are decided now, and the time (microseconds) after which the next may be. Events before `watermark` are complete."""
        raise NotImplementedError


class Debounce(Timed):
    """A batch ends where no event follows within `quiet`, or with the last event within `most` of its first."""

    fields = ("path", "kind")

    def __init__(self, by: str, quiet: int, most: int):
        super().__init__(by, [by, "generation", "start", "end", "n_events", "changes"])
        self.quiet, self.most = quiet, most

    def start(self) -> dict:
        return {"generation": 0}

    def advance(self, kept, watermark):
        out, waiting, machine = [], kept["waiting"], kept["machine"]
        while waiting:
            n = 1
            while n < len(waiting) and waiting[n][0] <= min(waiting[n - 1][0] + self.quiet, waiting[0][0] + self.most):
                n += 1
            due = min(waiting[n - 1][0] + self.quiet, waiting[0][0] + self.most)
            if watermark <= due:  # an event up to then may still come
                return out, due
            merged: dict[str, str] = {}
            for _, _, path, kind in waiting[:n]:
                merged[path or ""] = stronger(merged.get(path or ""), kind or "change")
            machine["generation"] += 1
            changes = [{"path": p, "kind": k} for p, k in sorted(merged.items())]
            out.append((machine["generation"], pd.Timestamp(waiting[0][0], unit="us"), pd.Timestamp(waiting[n - 1][0], unit="us"), n, changes))
            kept["upto"] = due
            del waiting[:n]
        return out, None


def debounced(events: DataFrame, by: str, quiet_us: int, most_us: int, late: str = "1 hour") -> DataFrame:
    """events (by, ts, event_id, path, kind) -> by, generation, start, end, n_events, changes: each path once, in order, with its strongest kind. Equal to review.debounce over the events that weren't late, with generations counted per key."""
    kind = events.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, generation long, start timestamp, end timestamp, n_events long, changes array<struct<path: string, kind: string>>"
    return _keyed(events, by, late).transformWithStateInPandas(Debounce(by, quiet_us, most_us), schema, "append", "eventTime")


def _keyed(events: DataFrame, by: str, late: str):
    provider = events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if "RocksDB" not in provider:
        raise ValueError("timers need spark.sql.streaming.stateStore.providerClass to name the RocksDB provider")
    return events.withWatermark("ts", late).groupBy(by)


TERMINAL = ("done", "moved", "conflict", "fail", "noop")


class Refresh(Timed):
    """The refresh loop of one key. See `refresh_loop`."""

    fields = ("step", "path", "kind")

    def __init__(self, by: str):
        super().__init__(by, [by, "event_id", "step", "generation", "phase", "outcome", "hinted"])

    def start(self) -> dict:
        return {"generation": 0, "phase": "idle", "building": None, "dirty": {}}

    def advance(self, kept, watermark):
        out, waiting = [], kept["waiting"]
        while waiting and waiting[0][0] < watermark:
            at, event_id, step, path, kind = waiting.pop(0)
            outcome, hinted = self.take(kept["machine"], step, path, kind)
            out.append((event_id, step, kept["machine"]["generation"], kept["machine"]["phase"], outcome, hinted))
            kept["upto"] = at - 1  # others of the same time may wait behind it
        if out and not (waiting and waiting[0][0] == kept["upto"] + 1):
            kept["upto"] += 1
        return out, waiting[0][0] if waiting else None

    @staticmethod
    def take(m: dict, step: str, path: str | None, kind: str | None) -> tuple[str | None, list[dict] | None]:
        def dirty(path: str, kind: str) -> None:
            m["dirty"][path] = stronger(m["dirty"].get(path), kind)
            m["generation"] += 1
            m["phase"] = "dirty"

        if step == "change":
            dirty(path or ".", kind or "change")
            return None, None
        if step == "begin":
            m["building"], m["phase"] = m["generation"], "refreshing"
            return None, [{"path": p, "kind": k} for p, k in sorted(m["dirty"].items())]
        if step not in TERMINAL or m["building"] is None:
            return "ignored", None
        current, m["building"] = m["building"] == m["generation"], None
        if step == "fail":
            m["phase"] = "failed"
            return "failed", None
        if not current:
            m["phase"] = "dirty"
            return "obsolete", None
        if step in ("moved", "conflict"):
            dirty(".", "rescan")
            return "requeued", None
        m["dirty"], m["phase"] = {}, "idle"
        return "published" if step == "done" else "noop", None


def refresh_loop(events: DataFrame, by: str, late: str = "1 hour") -> DataFrame:
    """events (by, ts, event_id, step, path, kind) -> by, event_id, step, generation, phase, outcome, hinted, in order of time.

    change: the path is dirty, a new generation. begin: a build of the present generation starts; hinted are the
    dirty paths it is given. A build ends with done, noop (nothing had changed), moved (the tree isn't what was
    built), conflict (another head was published) or fail. Where changes came meanwhile it is obsolete and the
    paths stay dirty; else done and noop leave nothing dirty, moved and conflict ask for a rescan of the whole in
    a new generation. fail keeps the paths. An end without a build is ignored.
    """
    kind = events.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, event_id long, step string, generation long, phase string, outcome string, hinted array<struct<path: string, kind: string>>"
    return _keyed(events, by, late).transformWithStateInPandas(Refresh(by), schema, "append", "eventTime")
