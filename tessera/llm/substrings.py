"""Exact repeated substrings from a collection's Burrows-Wheeler transform, built column by column.

Dealing out. Each `length`-byte window picks the least hash of its k-grams (k = `gram`), the leftmost of
equals: equal windows pick equal k-grams at the same place. Neighbouring windows of a text that pick the
same occurrence form one context; a context is the bytes of its windows, and its key is the k-gram's hash.
So equal windows always meet under one key, and only keys seen twice go on. Contexts that are equal byte
for byte are one context with a count before anything is gathered, which keeps hot passages small.

Construction. The contexts of a block, cut into 16-byte symbols from the picked k-gram outwards, are
inserted right to left, one symbol a context and round. A round reads the transform, the common
prefixes, first symbols and successors of all suffixes from sequential files, merges the new suffixes
in and writes the next files. In the end suffixes with a common prefix of length - d bytes, d < 16,
whose preceding symbols end in the same d bytes are windows that repeat; so every byte offset is judged,
though only every sixteenth suffix is sorted.

A key with more than `most` different contexts is too hot for one block. Its contexts are dealt out anew by a
longer k-gram: each window takes its gram with as many bytes more to the right as reach halfway to the whole
window, or to the left where they don't fit, so a context falls into two parts at most, and equal windows
still meet. Parts of keys that are still hot go on; a gram as long as a window has one context only.

Defined results: matches never cross documents; null or shorter texts keep all their bytes; repeated rows
are documents of their own, so each is a repeat of the other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialize, partitions
from tessera.llm.bytetext import batch_text, blocks, mix, prefix_hash, small_batches, span_hash, window_argmin
from tessera.llm.prefilter import only_maybe, split

CHUNK = 4 << 20


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of texts: text number, first and last window start (absolute), place of the picked k-gram, its hash."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    picked = window_argmin(grams, length - gram + 1)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(picked)]
    start = np.flatnonzero(np.arange(len(picked)) + length <= offs[text + 1])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    p, t = picked[start], text[start]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (t[1:] != t[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return t[first], start[first], start[last], p[first], grams[p[first]]


FOUND = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("place", pa.int32())])


def _find(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in blocks(batches, "text"):
        for lo in range(0, max(1, len(data)), CHUNK):  # more than one only for a single very long text
            hi = min(len(data), lo + CHUNK + length - 1)
            if lo and hi - lo < length:
                break
            part, own = data[lo:hi], (offs if len(data) <= CHUNK else np.array([0, hi - lo]))
            t, a, b, p, h = anchors(part, own, length, gram)
            raw = part.tobytes()
            digest = np.frombuffer(b"".join(hashlib.blake2b(raw[x : y + length], digest_size=8).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64)
            rows = pa.array(t)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(digest), batch.column("id").take(rows), batch.column("th").take(rows), pa.array(a - own[t] + lo), pa.array((b - a + 1).astype(np.int32)), pa.array((p - a).astype(np.int32))], schema=FOUND)
            if len(data) <= CHUNK:
                break


class Files:
    """Named arrays in sequential files of one folder. A new round writes new files and removes the old ones:
    some file systems flush a file that is written over, and a removed one needn't reach the disk."""

    def __init__(self, folder: str):
        self.folder, self.names = folder, {}

    def write(self, **arrays: np.ndarray) -> None:
        for name, x in arrays.items():
            old, turn = self.names.get(name, (None, 0))
            fresh = f"{self.folder}/{name}-{turn + 1}"
            x.tofile(fresh)
            self.names[name] = fresh, turn + 1
            if old:
                os.unlink(old)

    def read(self, name: str, kind) -> np.ndarray:
        return np.fromfile(self.names[name][0], kind)

    def clear(self) -> None:
        for name, _ in self.names.values():
            os.unlink(name)
        self.names = {}


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) of each range (lo < hi), long ones by minima of 64."""
    out = np.empty(len(lo), values.dtype)
    padded = np.append(values, values[-1:])
    short = hi - lo <= 256
    if short.any():
        out[short] = np.minimum.reduceat(padded, np.stack([lo[short], hi[short]], 1).reshape(-1))[::2]
    if not short.all():
        a, b = lo[~short], hi[~short]
        whole = np.full(-(-len(values) // 64) * 64, np.iinfo(values.dtype).max, values.dtype)
        whole[: len(values)] = values
        coarse = np.append(whole.reshape(-1, 64).min(axis=1), np.iinfo(values.dtype).max)
        a64, b64 = -(-a // 64), b // 64
        m = np.minimum.reduceat(coarse, np.stack([a64, b64], 1).reshape(-1))[::2]
        head = np.minimum.reduceat(padded, np.stack([a, np.maximum(a64 * 64, a + 1)], 1).reshape(-1))[::2]
        tail = np.minimum.reduceat(padded, np.stack([np.minimum(b64 * 64, b - 1), b], 1).reshape(-1))[::2]
        out[~short] = np.minimum(np.minimum(head, tail), m)
    return out


WIDE = 16


def symbols_of(room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-byte symbols as order-keeping numbers from 1, and their two 8-byte halves by number (0: none)."""
    halves = room.view(">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort([halves[:, 1], halves[:, 0]])
    ordered = halves[order]
    number = np.empty(len(halves), np.uint64)
    number[order] = np.cumsum(np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)]))
    values = np.zeros((int(number.max()) + 1, 2), np.uint64)
    values[number.astype(np.int64)] = halves
    return number, values


def common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of pairs of 16-byte symbols."""
    x = a ^ b
    out = np.zeros(len(x), np.int64)
    for k in range(1, 9):
        out += (x[:, 0] >> np.uint64(64 - 8 * k)) == 0
    for k in range(1, 9):
        out += (x[:, 0] == 0) & ((x[:, 1] >> np.uint64(64 - 8 * k)) == 0)
    return out


def build(number: np.ndarray, values: np.ndarray, offs: np.ndarray, files: Files) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context, symbol place, preceding symbol (0 for none) and common prefix with the suffix before (bytes) of all suffixes in order.

    Column-wise: suffixes of all contexts grow by one symbol a round; a suffix's place follows from its
    first symbol and the place of what follows it, held together as one key.
    """
    n = len(offs) - 1
    sizes = np.diff(offs)
    low, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
    # round 0: the empty suffixes, in order of contexts
    place = np.arange(n)
    files.write(key=np.arange(n, dtype=np.uint64), lcp=np.zeros(n, np.int32), bwt=np.zeros(n, np.uint32))
    for turn in range(int(sizes.max(initial=0))):
        who = np.flatnonzero(sizes > turn)
        symbol = number[offs[1:][who] - 1 - turn]
        key, lcp, bwt = files.read("key", np.uint64), files.read("lcp", np.int32), files.read("bwt", np.uint32)
        bwt[place[who]] = symbol  # what stands before the suffixes of the last round is known now
        fresh = (symbol << shift) | place[who].astype(np.uint64)
        order = np.argsort(fresh)
        who, fresh = who[order], fresh[order]
        gap = np.searchsorted(key, fresh)
        m, k = len(key), len(who)
        there = gap + np.arange(k)
        old = np.ones(m + k, bool)
        old[there] = False
        moved = np.flatnonzero(old)

        def merged(x: np.ndarray, new, moved=moved, there=there, size=m + k) -> np.ndarray:
            out = np.empty(size, x.dtype)
            out[moved] = x
            out[there] = new
            return out

        key2 = merged(key, fresh)
        lcp2 = merged(lcp, 0)
        # common prefixes change at new suffixes and just after them
        touched = np.unique(np.concatenate([there, there + 1]))
        touched = touched[(touched > 0) & (touched < m + k)]
        before, here = key2[touched - 1], key2[touched]
        a, b = (before >> shift).astype(np.int64), (here >> shift).astype(np.int64)
        fill = np.where((a > 0) & (b > 0), common_bytes(values[a], values[b]), 0)
        same = (a == b) & (a > 0)
        if same.any():
            fill[same] = WIDE + range_minima(lcp, (before[same] & low).astype(np.int64) + 1, (here[same] & low).astype(np.int64) + 1)
        lcp2[touched] = fill
        files.write(key=(key2 & ~low) | moved[(key2 & low).astype(np.int64)].astype(np.uint64), lcp=lcp2, bwt=merged(bwt, 0))
        place = moved[place]
        place[who] = there
    # which suffix is whose: from each whole context along what follows
    follow = (files.read("key", np.uint64) & low).astype(np.int64)
    context, at = np.empty(len(follow), np.int64), np.empty(len(follow), np.int64)
    spot = place.copy()
    for turn in range(int(sizes.max(initial=0)) + 1):
        who = np.flatnonzero(sizes >= turn)
        context[spot[who]], at[spot[who]] = who, turn
        spot[who] = follow[spot[who]]
    return context, at, files.read("bwt", np.uint32).astype(np.int64), files.read("lcp", np.int32)


def repeats(texts: list[bytes], places: np.ndarray, windows: np.ndarray, counts: np.ndarray, length: int, files: Files) -> np.ndarray:
    """(context, window) rows, sorted, of all windows that are found at least twice. places: of the k-gram in each context."""
    lead = -places % WIDE  # so that symbols are cut from the k-gram outwards
    size = np.array([len(t) for t in texts])
    offs = np.concatenate([[0], np.cumsum((lead + size + WIDE - 1) // WIDE)])
    room = np.zeros(int(offs[-1]) * WIDE, np.uint8)
    for t, o in zip(texts, (offs[:-1] * WIDE + lead).tolist(), strict=True):
        room[o : o + len(t)] = np.frombuffer(t, np.uint8)
    number, values = symbols_of(room)
    context, at, before, lcp = build(number, values, offs, files)
    # only suffixes that a window starts in, or up to 15 bytes before
    some = np.flatnonzero(at * WIDE - lead[context] - WIDE < windows[context])
    first = at[some] * WIDE - lead[context[some]]
    found = []
    for d in range(WIDE):
        run = np.cumsum(lcp < length - d)
        window = first - d
        pick = (window >= 0) & (window < windows[context[some]])
        valid, w = some[pick], window[pick]
        if not len(valid):
            continue
        high, lo = values[before[valid], 0], values[before[valid], 1]
        mask = lambda n: np.uint64((1 << (8 * n)) - 1)
        high, lo = high & mask(max(0, d - 8)), lo & mask(min(d, 8))
        order = np.lexsort([lo, high, run[valid]] if d > 8 else [lo, run[valid]])
        r, x, y = run[valid][order], high[order], lo[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        group = np.cumsum(new) - 1
        n = np.bincount(group, weights=counts[context[valid]][order])
        hit = n[group] > 1
        found.append(np.stack([context[valid][order][hit], w[order][hit]], 1))
    out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return out[np.lexsort([out[:, 1], out[:, 0]])]


MARKS = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])
SPANS = "array<struct<lo:int,hi:int>>"
SPANS_OF_TEXT = "array<struct<lo:bigint,hi:bigint>>"


def _mark(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: marks of all contexts, in blocks of whole keys."""
    folder = tempfile.mkdtemp()
    rows: list[tuple] = []
    try:

        def solve(block_rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not block_rows:
                return
            key, digest, windows, places, counts, texts = zip(*block_rows, strict=True)
            files = Files(folder)
            hits = repeats(list(texts), np.array(places), np.array(windows), np.array(counts), length, files)
            files.clear()
            spans: list[list[dict]] = [[] for _ in texts]
            if len(hits):
                new = np.concatenate([[True], (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1] + 1)])
                lo = np.flatnonzero(new)
                hi = np.concatenate([lo[1:], [len(hits)]]) - 1
                for c, a, b in zip(hits[lo, 0].tolist(), hits[lo, 1].tolist(), hits[hi, 1].tolist(), strict=True):
                    spans[c].append({"lo": a, "hi": b})
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.int64()), pa.array(spans, MARKS.field("spans").type)], schema=MARKS)

        held = 0
        for batch in batches:
            data, offs = batch_text(batch.column("bytes"))
            columns = [batch.column(c).to_pylist() for c in ("key", "digest", "windows", "place", "n")]
            for k, (key, digest, windows, place, n) in enumerate(zip(*columns, strict=True)):
                row = (key, digest, windows, place, n, data[offs[k] : offs[k + 1]].tobytes())
                if held > block and rows[-1][0] != key:
                    yield from solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[5])
        yield from solve(rows)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


PARTS = "key0 long, digest0 long, lo int, key long, digest long, windows int, place int, gram int, n long, bytes binary"


def parts_by_longer_gram(raw: bytes, windows: int, place: int, gram: int, length: int) -> Iterator[tuple[int, int, int, bytes]]:
    """First window, number of windows, place of the longer gram (in the context) and its bytes, for each part of a context."""
    longer = (length + gram + 1) // 2
    cut = min(max(place - (length - longer), 0), windows)  # windows from here on have room to the right
    for lo, hi, start in ((0, cut, place + gram - longer), (cut, windows, place)):
        if hi > lo:
            yield lo, hi - lo, start, raw[start : start + longer]


def _extend(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PARTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    number = lambda raw: int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)
    for batch, _, _ in blocks(batches, "bytes"):
        out: list[list] = [[] for _ in names]
        for r in batch.to_pylist():
            for lo, windows, start, own in parts_by_longer_gram(r["bytes"], r["windows"], r["place"], r["gram"], length):
                raw = r["bytes"][lo : lo + windows - 1 + length]
                for column, v in zip(out, (r["key0"], r["digest0"], r["lo"] + lo, number(own), number(raw), windows, start - lo, len(own), r["n"], raw), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts listed for each text."""
    names = ["key", "digest", "windows", "place", "n", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    for batch, data, offs in blocks(batches, "text"):
        raw, out = data.tobytes(), [[] for _ in names]
        for o, own in zip(offs[:-1].tolist(), batch.column("contexts").to_pylist(), strict=True):
            for c in own or ():
                for column, v in zip(out, (c["key"], c["digest"], c["windows"], c["place"], c["n"], raw[o + c["start"] : o + c["start"] + c["windows"] - 1 + length]), strict=True):
                    column.append(v)
        for lo in range(0, len(out[0]), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 2000], k) for c, k in zip(out, kinds, strict=True)], names)


def _remove(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Unites each text's spans and gives what stays."""
    for batch, data, offs in blocks(batches, "text"):
        raw, sizes, removed, spans, kept = data.tobytes(), [], [], [], []
        for o, e, own in zip(offs[:-1].tolist(), offs[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for x in sorted(own or (), key=lambda x: x["lo"]):
                if merged and x["lo"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x["hi"])
                else:
                    merged.append([x["lo"], x["hi"]])
            at, pieces = o, []
            for a, b in merged:
                pieces.append(raw[at : o + a])
                at = o + b
            kept.append(b"".join([*pieces, raw[at:e]]))
            sizes.append(e - o)
            removed.append(sum(b - a for a, b in merged))
            spans.append([{"lo": a, "hi": b} for a, b in merged])
        cols = {"id": batch.column("id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        yield pa.RecordBatch.from_pydict({n: cols[n] for n in names})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 128, most: int = 1024, block: int = 1 << 20, payload: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, spans (byte offsets in the text, maximal and apart) and kept_sha256 for each row; with payload also kept, the bytes that stay."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    slim = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(F.xxhash64(docs[text_col]), F.lit(0)).alias("th"), docs[text_col].alias("text"))
    found = materialize(slim.where(F.octet_length("text") >= length).mapInArrow(lambda b: _find(b, length, gram), "key long, digest long, id long, th long, start long, windows int, place int"), "contexts")
    # written first, so that the join has exchanges of its own on both sides and a hot key can be split
    twice = materialize(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    again = materialize(only_maybe(found, twice, "key").join(twice, "key", "left_semi"), "repeated")
    distinct = again.groupBy("key", "digest").agg(F.min(F.struct("id", "th", "start", "windows", "place")).alias("x"), F.count("*").alias("n")).select("key", "digest", "x.*", "n")
    distinct = materialize(distinct, "distinct")
    hot_keys = materialize(distinct.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > most).select("key"), "hot")
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])

    def with_bytes(contexts: DataFrame) -> DataFrame:
        listed = contexts.groupBy("id", "th").agg(F.collect_list(F.struct("key", "digest", "start", "windows", "place", "n")).alias("contexts"))
        # a repeated row would give its contexts twice: counts are taken, so one of them is enough
        own = only_maybe(slim, contexts.select("id", "th"), "id", "th")
        texts = own.join(listed, same(own, listed)).select("text", "contexts", own["id"], own["th"])
        return texts.mapInArrow(lambda b: _cut(b, length), "key long, digest long, windows int, place int, n long, bytes binary")

    def marked(contexts: DataFrame) -> DataFrame:
        dealt = contexts.repartition(partitions(spark), "key").sortWithinPartitions("key", "digest")
        marks = materialize(dealt.mapInArrow(lambda b: _mark(b, length, block), f"key long, digest long, spans {SPANS}"), "marks")
        return marks.where("size(spans) > 0").select("key", "digest", F.explode("spans").alias("s")).select("key", "digest", "s.*")

    if hot_keys.isEmpty():
        usual = marked(with_bytes(distinct)).distinct()
    else:
        usual = marked(with_bytes(distinct.join(hot_keys, "key", "left_anti")))
        parts = with_bytes(distinct.join(hot_keys, "key", "left_semi"))
        parts = parts.select(F.col("key").alias("key0"), F.col("digest").alias("digest0"), F.lit(0).alias("lo"), "key", "digest", "windows", "place", F.lit(gram).alias("gram"), "n", "bytes")
        while True:
            parts = materialize(parts.mapInArrow(lambda b: _extend(b, length), PARTS), "parts")
            # bytes stay out of the sums: one row of each context brings them afterwards
            sums = materialize(parts.groupBy("key", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("key0", "digest0", "lo")).alias("one")), "sums")
            still = materialize(sums.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > most).select("key"), "hot")
            one = sums.join(still, "key", "left_anti").select("one.*", "key", "digest", "n")
            several = parts.drop("n").join(one, ["key0", "digest0", "lo", "key", "digest"]).select("key", "digest", "windows", "place", "n", "bytes")
            found = marked(several).withColumnsRenamed({"lo": "from", "hi": "to"})
            back = parts.select("key0", "digest0", "lo", "key", "digest").join(found, ["key", "digest"])
            usual = usual.unionByName(back.select(F.col("key0").alias("key"), F.col("digest0").alias("digest"), (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi")))
            if still.isEmpty():
                break
            parts = parts.join(still, "key", "left_semi").select(*[x.split()[0] for x in PARTS.split(", ")])
        usual = materialize(usual.distinct(), "usual")
    spans = again.join(usual, ["key", "digest"]).select("id", "th", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + length).alias("hi"))
    owned = materialize(spans.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "owned")
    some, rest = split(slim, owned, "id", "th")  # texts without repeats don't meet the join
    full = some.join(owned, same(some, owned), "left").select(some["id"], "text", "spans").unionByName(rest.select("id", "text", F.lit(None).cast(SPANS_OF_TEXT).alias("spans")))
    names = ["id", "n_bytes", "n_removed", "spans", *["kept"] * payload, "kept_sha256"]
    return full.mapInArrow(lambda b: _remove(b, names), f"id long, n_bytes long, n_removed long, spans array<struct<lo:bigint,hi:bigint>>, {'kept binary, ' * payload}kept_sha256 string")
