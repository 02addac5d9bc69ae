"""A folder's changes as a stream: a data source whose offsets are digests of listings.

Each trigger lists the folder (path, size, time of change), stores the listing under its digest in the `state` folder,
and takes the digest as the newest offset. A batch is what differs between two listings; its tasks read both from the
state folder and each compares its own share of the paths, so neither the driver nor a task holds a batch's rows. A
query that starts again from its checkpoint goes on from the listing it had finished. The same listing twice is no
batch.

Both folders must be seen as files by the driver, and the state folder by all executors. A file that changes twice
between two triggers is one change. Files that vanish while they are listed are left out of that listing.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, kind string, seen timestamp"
#: Folders that are never watched, and ends of database files. Fixed values.
IGNORED = ("node_modules", ".git", "dist", "build", "out", "coverage", ".next", ".turbo", ".cache")
DATABASES = (".db", ".sqlite", ".sqlite3", "-wal", "-shm")


def listing(root: str, ignored: tuple[str, ...]) -> dict[str, list[int]]:
    found, folders = {}, [""]
    while folders:
        at = folders.pop()
        try:
            entries = list(os.scandir(os.path.join(root, at)))
        except FileNotFoundError:
            continue
        for e in entries:
            name = f"{at}/{e.name}" if at else e.name
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in ignored:
                        folders.append(name)
                elif e.is_file(follow_symlinks=False) and not e.name.lower().endswith(DATABASES):
                    s = e.stat(follow_symlinks=False)
                    found[name] = [s.st_size, s.st_mtime_ns]
            except FileNotFoundError:
                continue
    return found


class Share(InputPartition):
    def __init__(self, before: str, after: str, part: int, of: int):
        super().__init__(part)
        self.before, self.after, self.part, self.of = before, after, part, of


class Changes(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["path"], options["state"]
        self.ignored = tuple(x for x in options.get("ignored", ",".join(IGNORED)).split(",") if x)
        self.shares = int(options.get("shares", "4"))

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        files = sorted(listing(self.root, self.ignored).items())
        digest = hashlib.sha256(json.dumps(files).encode()).hexdigest()
        place = os.path.join(self.state, f"{digest}.json")
        if not os.path.exists(place):
            os.makedirs(self.state, exist_ok=True)
            made = f"{place}.{uuid.uuid4().hex}"
            with open(made, "w", encoding="utf-8") as f:
                json.dump({"seen": time.time_ns() // 1000, "files": files}, f)
            os.replace(made, place)  # a listing is there whole or not at all
        return {"listing": digest}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [] if start["listing"] == end["listing"] else [Share(start["listing"], end["listing"], k, self.shares) for k in range(self.shares)]

    def _load(self, digest: str, share: Share) -> tuple[dict, int]:
        if not digest:
            return {}, 0
        with open(os.path.join(self.state, f"{digest}.json"), encoding="utf-8") as f:
            stored = json.load(f)
        return {p: v for p, v in stored["files"] if zlib.crc32(p.encode("utf-8", "surrogateescape")) % share.of == share.part}, stored["seen"]

    def read(self, share: Share) -> Iterator[tuple]:
        from datetime import datetime, timezone

        before, after = self._load(share.before, share)[0], self._load(share.after, share)
        seen = datetime.fromtimestamp(after[1] / 1e6, timezone.utc)
        for path in sorted(before.keys() | after[0].keys()):
            old, new = before.get(path), after[0].get(path)
            if old != new:
                yield path, "rename" if old is None or new is None else "change", seen

    def commit(self, end: dict) -> None:
        pass  # listings stay: a query may start again from any offset of its log


class FolderChanges(DataSource):
    """spark.readStream.format("folder_changes").option("path", ...).option("state", ...): path, kind (rename where a file came or went, else change), seen."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Changes:
        return Changes(self.options)


def folder_changes(spark: SparkSession, path: str, state: str, **options: str) -> DataFrame:
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").options(path=path, state=state, **options).load()
