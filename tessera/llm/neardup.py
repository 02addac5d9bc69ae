"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

SuperMinHash gives every set element one random permutation of the slots; in round j an element offers
j + r (r uniform) to the j-th slot of its permutation, and a slot keeps its least offer. Offers of later
rounds are larger, so a slot that has one is final and a document stops in the round that fills its last
slot. Here all elements of a block of documents take a round together; permutations are only built for
the documents that need a second one. Signatures are cut into bands; documents that share a band are
candidates. With 40 bands of 4 a pair at similarity 0.8 is missed with probability 7e-10.

Sets that are equal are one set with its smallest id as representative. Candidate links are the star of
each band's bucket around its smallest id, never all its pairs; their components are found by repeated
joins and bound the search. Inside one component, full sets are compared by union-find around pivots: a
document that is found linked joins, and joined documents seek only among those not joined yet, so no
link between different sets is lost. Components of more than `block_docs` sets are cut into blocks that
are solved apart; then all sets outside the largest of the found groups are put against every block, a
block's worth of them at a time, so no task holds more than two blocks of sets.

Defined results: without words or text (null, empty, blanks) the set is empty and linked with nothing;
a null id never represents a set: its row takes the component of an equal set or else null, and isn't kept;
repeated rows share their component, and different texts under one id may be joined by it; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialize, partitions
from tessera.llm.bytetext import LOWER, SPACED, blocks, find_words, mix, prefix_hash, small_batches, span_hash
from tessera.llm.prefilter import only_maybe

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their offsets. Fewer words than width: the whole sequence is one."""
    data = LOWER[raw]
    s, e, at = find_words(SPACED, data, offs)
    h = span_hash(prefix_hash(data), s, e)
    n_words = np.diff(at)
    n = len(n_words)
    m = len(h) - width + 1
    grams = np.zeros(max(m, 0), np.uint64)
    for k in range(width if m > 0 else 0):
        grams += h[k : k + m] * ODD[k % len(ODD)] + np.uint64(k)
    grams = mix(grams)
    parts, sizes = [], np.zeros(n, np.int64)
    for d in range(n):
        if n_words[d] >= width:
            own = np.unique(grams[at[d] : at[d + 1] - width + 1])
        elif n_words[d]:
            v = np.uint64(n_words[d])
            with np.errstate(over="ignore"):
                for x, c in zip(h[at[d] : at[d + 1]], ODD, strict=False):
                    v = v * ODD[7] + x * c
            own = mix(np.array([v], np.uint64))
        else:
            continue
        sizes[d] = len(own)
        parts.append(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def superminhash(elements: np.ndarray, offs: np.ndarray, slots: int) -> np.ndarray:
    """A row of `slots` offers (round in the upper bits, random below) for each non-empty set."""
    n = len(offs) - 1
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * slots, none)
    doc = np.repeat(np.arange(n), np.diff(offs))
    seed, perm = elements, None
    for turn in range(slots):
        draw = mix(seed + np.array(turn, np.uint64).reshape(1) * ODD[0])
        pick = (((draw >> np.uint64(40)) * np.uint64(slots - turn)) >> np.uint64(24)).astype(np.int64) + turn
        if perm is None:
            slot, first = pick, pick
        else:
            row = np.arange(len(seed))
            slot = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[:, turn]
        offer = (np.uint64(turn) << np.uint64(56)) | (mix(draw) >> np.uint64(8))
        np.minimum.at(best, doc * slots + slot, offer)
        short = (best.reshape(n, slots) == none).any(axis=1)
        go = short[doc]
        if not go.any():
            break
        doc, seed = doc[go], seed[go]
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(seed), 1))
            perm[np.arange(len(seed)), first[go]] = 0
        else:
            perm = perm[go]
    return best.reshape(n, slots)


SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch, raw, offs in blocks(batches, "text", 1 << 20):
        sets, at = shingle_sets(raw, offs, width)
        signature = superminhash(sets, at, bands * rows)
        keys = np.zeros((batch.num_rows, bands), np.uint64)
        for k in range(rows):
            keys = mix(keys * ODD[1] + signature[:, k::rows] + np.uint64(1))
        keys = mix(keys + np.arange(bands, dtype=np.uint64) * ODD[2]).view(np.int64)
        sizes = np.diff(at)
        data = sets.tobytes()
        digest = [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), lists], schema=SIGNED)


def components(edges: DataFrame) -> DataFrame:
    """a, b -> node, root (its component's smallest node). Large-star and small-star by turns until nothing changes."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")  # joins with exchanges of their own can split a hot node
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = materialize(large.where("u <> v").distinct(), "down")
        low = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def linked(pivot: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of the sets have num/den similarity to the pivot, by exact intersection. Sizes too far apart are told at once."""
    sizes = np.array([len(x) for x in sets])
    fit = np.flatnonzero((sizes * num <= len(pivot) * den) & (len(pivot) * num <= sizes * den))
    out = np.zeros(len(sets), bool)
    if len(fit):
        flat = np.concatenate([sets[i] for i in fit])
        at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        common = np.add.reduceat((pivot[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[fit])[:-1]]))
        out[fit] = den * common >= num * (sizes[fit] + len(pivot) - common)
    return out


def solve(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the index of the first set of its group. Each set is the pivot once, against those not joined with it yet."""
    union = Union(len(sets))
    waiting = list(range(len(sets)))
    while waiting:
        front = [waiting.pop(0)]
        while front and waiting:
            pivot = front.pop()
            hit = linked(sets[pivot], [sets[i] for i in waiting], num, den)
            joined = [i for i, h in zip(waiting, hit, strict=True) if h]
            for i in joined:
                union.join(pivot, i)
            front += joined
            waiting = [i for i, h in zip(waiting, hit, strict=True) if not h]
    return [union.find(i) for i in range(len(sets))]


def _solve_groups(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (unit, id); a unit's sets are held together, and a unit is bounded by the block size."""
    unit, ids, sets = None, [], []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "label": pa.array([ids[i] for i in solve(sets, num, den)], pa.int64())})

    for batch, raw, offs in blocks(batches, "text"):
        flat, at = shingle_sets(raw, offs, width)
        for k, (u, i) in enumerate(zip(batch.column("unit").to_pylist(), batch.column("id").to_pylist(), strict=True)):
            if u != unit:
                if ids:
                    yield done()
                unit, ids, sets = u, [], []
            ids.append(i)
            sets.append(flat[at[k] : at[k + 1]].copy())
    if ids:
        yield done()


def _cross(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (unit, asks first): each block's asking sets against its own sets of other labels; a link of labels is emitted once."""
    unit, asks, seen = None, [], set()
    for batch, raw, offs in blocks(batches, "text"):
        flat, at = shingle_sets(raw, offs, width)
        links = []
        for k, (u, own, label) in enumerate(zip(batch.column("unit").to_pylist(), batch.column("own").to_pylist(), batch.column("label").to_pylist(), strict=True)):
            if u != unit:
                unit, asks, seen = u, [], set()
            x = flat[at[k] : at[k + 1]].copy()
            if not own:
                asks.append((label, x))
                continue
            todo = [(b, y) for b, y in asks if b != label and (b, label) not in seen]
            if todo:
                for (b, _), h in zip(todo, linked(x, [y for _, y in todo], num, den), strict=True):
                    if h and (b, label) not in seen:
                        seen.add((b, label))
                        links.append((b, label))
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 80, den: int = 100, bands: int = 40, rows: int = 4, block_docs: int = 1024) -> DataFrame:
    """id, n_shingles, component_id and kept for every row."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    signed = materialize(slim.mapInArrow(lambda b: _sign(b, width, bands, rows), "id long, n long, digest binary, bands array<bigint>"), "signed")
    reps = signed.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"))
    keys = reps.select("rep", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("rep").alias("b"), F.count("*").alias("size")).where("size > 1")
    stars = keys.join(buckets, "band").select(F.col("rep").alias("a"), "b")
    near = materialize(components(stars), "near")

    # units of at most block_docs sets; the first text of an id stands for it
    sizes = near.groupBy("root").agg(F.count("*").alias("size"))
    blocks_of = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / (block_docs / 2)))
    units = near.join(sizes, "root").select(F.col("node").alias("id"), "root", F.when(F.col("size") > block_docs, blocks_of).otherwise(F.lit(0)).alias("part"), (F.col("size") > block_docs).alias("cut"))
    maybe = only_maybe(slim, near.select(F.col("node").alias("id")), "id")  # texts without candidates aren't shuffled
    member = materialize(maybe.join(units, "id"), "members")
    by_unit = member.withColumn("unit", F.xxhash64("root", "part")).select("unit", "id", "text")
    dealt = lambda df, *order: df.repartition(partitions(spark), "unit").sortWithinPartitions("unit", *order)
    solved = materialize(dealt(by_unit, "id").mapInArrow(lambda b: _solve_groups(b, width, num, den), "id long, label long"), "solved")
    if near.join(sizes, "root").where(F.col("size") > block_docs).limit(1).count():
        solved = _across(member, solved, dealt, width, num, den, block_docs)

    label = solved.groupBy("id").agg(F.min("label").alias("label"))
    named = reps.join(label, reps["rep"] == label["id"], "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    named = materialize(named, "named")  # its join has exchanges of its own, so a hot set can be split
    # empty sets have no digest; a key of their own keeps them apart
    apart = F.coalesce("digest", F.xxhash64("id", F.lit(3)).cast("string").cast("binary"))
    out = signed.select("id", F.col("n").alias("n_shingles"), apart.alias("digest")).join(named, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _across(member: DataFrame, solved: DataFrame, dealt, width: int, num: int, den: int, block_docs: int) -> DataFrame:
    """Joins the groups that blocks of one large component found apart: first around one probe a block, then all sets outside the largest group against every block."""
    cut = member.where("cut").join(solved, "id").select("root", "part", "id", "label", "text")
    parts = cut.select("root", "part").distinct()
    for turn in range(2):
        sizes = cut.groupBy("root", "label").agg(F.count("*").alias("n"))
        if turn:
            largest = sizes.groupBy("root").agg(F.max(F.struct("n", "label"))["label"].alias("big"))
            asks = cut.join(largest, "root").where("label <> big")
        else:
            asks = cut.join(sizes.where("n > 1"), ["root", "label"]).where("id = label OR pmod(xxhash64(id), n) < 8")
        # asking sets come in turns of about a block, so a task holds no more of them
        turns = asks.groupBy("root").agg(F.ceil(F.count("*") / block_docs).alias("turns"))
        asks = asks.join(turns, "root").withColumn("turn", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("turns")))
        asks = asks.select("root", "id", "label", "text", "turn").join(parts, "root")
        own = cut.join(turns, "root").select("root", "id", "label", "text", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn")).withColumn("own", F.lit(True))
        both = asks.withColumn("own", F.lit(False)).unionByName(own).withColumn("unit", F.xxhash64("root", "part", "turn"))
        links = dealt(both, "own", "id").mapInArrow(lambda b: _cross(b, width, num, den), "a long, b long").where("a <> b")
        merged = components(links)
        new = F.coalesce("root2", "label")
        cut = materialize(cut.join(merged.select(F.col("node").alias("label"), F.col("root").alias("root2")), "label", "left").withColumn("label", new).drop("root2"), "cut")
    return solved.join(cut.select("id"), "id", "left_anti").union(cut.select("id", "label"))
