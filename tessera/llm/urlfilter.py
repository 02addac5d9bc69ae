"""URL rules in a sorted digest array.

Every rule's key, host + path, has a 64-bit xxhash. Digests are sorted in one memory-mapped array beside
the keys' offsets and a blob of the full strings. A URL's candidate keys (each suffix of its host at a
label, with each rule-path length of its path) are hashed together, probed by one vectorised binary
search and confirmed against the stored strings, so a digest collision decides nothing.

Defined results: a null URL, or one without `://`, has empty host and path and fits no rule; without a
fitting rule the verdict is `default`. The longest key wins, among equally long the longer host; of
repeated rules the last one counts. Rules are dealt in parts of at most `part_bytes`, one broadcast each; a
pass over the pages takes `parts_a_pass` of them and is written before the next, so neither a broadcast nor
the memory of a task grows with the rules. A very long host gives no more keys than the rules' longest host
has labels.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shared import materialize

def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Sorted 64-bit digests with their strings; values are (verdict, host length)."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        table = {(h + p).encode(): (v, len(h.encode())) for h, p, v in rules}
        rows = sorted((xxhash.xxh64_intdigest(k), k, *v) for k, v in table.items())
        self.n = len(rows)
        self.digests = np.array([r[0] for r in rows], np.uint64).tobytes()
        self.ends = np.cumsum([len(r[1]) for r in rows], dtype=np.int64).tobytes()
        self.block = np.array([r[2] == "block" for r in rows], np.uint8).tobytes()
        self.hosts = np.array([r[3] for r in rows], np.int32).tobytes()
        self.blob = b"".join(r[1] for r in rows)
        self.path_lengths = sorted({len(k) - h for k, (_, h) in table.items()})
        self.most_labels = max((k[:h].count(b".") + 1 for k, (_, h) in table.items()), default=0)
        self._open = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def open(self) -> tuple[np.ndarray, ...]:
        """The arrays, mapped from a file that has no name any more: nothing stays behind."""
        if self._open is None:
            parts = [self.digests, self.ends, self.blob, self.block, self.hosts]
            kinds = [np.uint64, np.int64, np.uint8, np.uint8, np.int32]
            fd, name = tempfile.mkstemp()
            with os.fdopen(fd, "wb") as f:
                places = []
                for x in parts:
                    f.write(b"\0" * (-f.tell() % 8))
                    places.append(f.tell())
                    f.write(x)
                f.write(b"\0" * 8)
            self._open = tuple(np.memmap(name, k, "r", at, (len(x) // np.dtype(k).itemsize,)) if x else np.zeros(0, k) for x, k, at in zip(parts, kinds, places, strict=True))
            os.unlink(name)
        return self._open

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key, or -1."""
        digests, ends, blob, _, _ = self.open()
        probes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        lo, hi = np.searchsorted(digests, probes, "left"), np.searchsorted(digests, probes, "right")
        out = np.full(len(keys), -1, np.int64)
        for i in np.flatnonzero(hi > lo):
            for j in range(lo[i], hi[i]):
                if blob[ends[j - 1] if j else 0 : ends[j]].tobytes() == keys[i]:
                    out[i] = j
        return out


def candidates(host: str, path: str, path_lengths: list[int], most_labels: int) -> Iterator[bytes]:
    """The host's superdomains of up to `most_labels` labels (no rule's host has more), itself included, each with every rule-long prefix of the path."""
    raw = path.encode()[: path_lengths[-1]] if path_lengths else b""
    heads = [raw[:n] for n in path_lengths if n <= len(raw)]
    at = len(host)
    for _ in range(most_labels if host else 0):
        at = host.rfind(".", 0, at)
        own = host[at + 1 :].encode()
        if own:
            yield from (own + x for x in heads)
        if at < 0:
            break


def _probe(frames: Iterator[pd.DataFrame], array: DigestArray) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        keys, owner = [], []
        for i, (h, p) in enumerate(zip(pdf["host"], pdf["path"], strict=True)):
            own = list(candidates(h, p, array.path_lengths, array.most_labels))
            keys += own
            owner += [i] * len(own)
        found = array.find(keys)
        _, ends, blob, block, hosts = array.open()
        best: dict[int, tuple[int, int, int]] = {}
        for k in np.flatnonzero(found >= 0).tolist():
            j = int(found[k])
            best[owner[k]] = max(best.get(owner[k], (-1, -1, -1)), (len(keys[k]), int(hosts[j]), j))
        rule, verdict, strength = list(pdf["rule"]), list(pdf["verdict"]), list(pdf["strength"])
        for i, (size, host, j) in best.items():
            if (now := size << 31 | host) > strength[i]:
                rule[i], verdict[i], strength[i] = blob[ends[j - 1] if j else 0 : ends[j]].tobytes().decode(), "block" if block[j] else "allow", now
        yield pdf.assign(rule=pd.Series(rule, dtype=object), verdict=pd.Series(verdict, dtype=object), strength=strength)


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", keep: list[str] | None = None, default: str = "allow", part_bytes: int = 16 << 20, parts_a_pass: int = 4) -> DataFrame:
    """Kept input columns, host, path, rule (null without one) and verdict. rules: (host, path, allow or block)."""
    keep = pages.columns if keep is None else keep
    out = pages.select(F.struct(*[pages[f"`{c}`"] for c in keep]).alias("row"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(-1).cast("long").alias("strength"))
    slim = out.schema
    sc = pages.sparkSession.sparkContext
    for k, part in enumerate(_parts(rules, part_bytes)):
        if k and k % parts_a_pass == 0:
            out = materialize(out, "urls")
        shared = sc.broadcast(DigestArray(part))
        out = out.mapInPandas(lambda frames, shared=shared: _probe(frames, shared.value), T.StructType([T.StructField(f.name, f.dataType, True) for f in slim]))
    return out.select("row", "host", "path", "rule", "verdict")


def _parts(rules: Iterable[tuple[str, str, str]], part_bytes: int) -> Iterator[list[tuple[str, str, str]]]:
    part, size = [], 0
    for r in rules:
        part.append(r)
        size += len(r[0].encode()) + len(r[1].encode()) + 64
        if size > part_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part
