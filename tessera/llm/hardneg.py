"""Hard negatives by bit-sliced integer products.

Components are scaled to integers. A block of rows is scored against anchors one bit plane of the rows'
components (two's complement) at a time, the most significant first: the planes seen so far and the signs of
the anchor's components give an interval for each score. A pair is dropped once its interval cannot qualify:
for positives when it ends below the fifth best so far, for negatives when it meets the window of none of the
anchor's positives above that positive's fifth best so far. What is left after the last plane is exact.

Anchors go in blocks of at most `block_bytes`, each broadcast to one pass over all rows for positives and one
for negatives; a task keeps the best rows an anchor only, and windows over these give the result. The work is
anchors times rows, as asked; no pair leaves a task unless it is among its best.

Defined results: rows with a null id, label or vector, or with a component that is null, not finite or of a
size of 2**28 or more after scaling take no part. A vector is scored with vectors of its own length only;
empty vectors score 0. Repeated rows are rows each, but a row with the anchor's id is never its partner, and
equal anchors are one. Ties go to smaller ids. Empty tables, anchors without positives and positives without
negatives give no rows. Further columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize

LIMIT = 1 << 28
#: Rows and anchors that are multiplied at a time.
TILE = 1024
NONE = -(1 << 62)


def integer_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label (as a string) and integer components of the rows that take part."""
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    vec = vectors[f"`{vec_col}`"]
    fine = vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(F.abs(F.lit(float(scale)) * x.cast("double")) < LIMIT - 1, F.lit(False)))
    rows = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("id"), vectors[f"`{label_col}`"].cast("string").alias("label"), F.when(fine, F.transform(vec, lambda x: whole(x).cast("int"))).alias("c"))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND c IS NOT NULL")


class Anchors:
    """A block of anchors; `widths` has, for each vector length, the places of its anchors and their matrix."""

    def __init__(self, ids: np.ndarray, labels: list[str], vectors: list[np.ndarray]):
        self.ids = ids
        self.known = sorted(set(labels))
        code = {x: i for i, x in enumerate(self.known)}
        self.label = np.array([code[x] for x in labels], np.int64)
        at: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            at.setdefault(len(v), []).append(i)
        self.widths = {n: (np.array(places), np.array([vectors[i] for i in places], np.int64).reshape(len(places), n)) for n, places in at.items()}


def number_type(anchors: np.ndarray, rows: np.ndarray):
    """The fastest type in which every partial sum is exact."""
    most = lambda x: int(np.abs(x).max(initial=0))
    bound = 2 * most(anchors) * max(2 * most(rows), 1) * max(anchors.shape[1], 1)
    if bound >= 1 << 62:
        raise ValueError("scores do not fit 64 bits")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def progressive(anchors: np.ndarray, rows: np.ndarray, alive: np.ndarray, may) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and exact score of the pairs of `alive` (anchors by rows) that no interval rules out.

    may(anchor places, low, high) -> bool, elementwise over pairs or over a matrix with an anchor a line.
    """
    kind = number_type(anchors, rows)
    a = anchors.astype(kind)
    least, most = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
    top = int(max(rows.max(initial=0), -1 - rows.min(initial=0))).bit_length()
    # dense while many pairs live
    cols, lines = np.arange(len(a)), np.arange(len(rows))
    part = np.zeros((len(a), len(rows)), kind)
    k = top
    while k >= 0:
        weight = kind(-(1 << k) if k == top else 1 << k)
        part += weight * (a[cols] @ ((rows[lines] >> k) & 1).astype(kind).T)
        rest = kind((1 << k) - 1)
        alive = alive & may(cols[:, None], part + rest * least[cols][:, None], part + rest * most[cols][:, None])
        k -= 1
        if alive.sum() * 8 < alive.size:
            break
        keep_a, keep_r = alive.any(1), alive.any(0)
        if keep_a.sum() * 2 < len(cols) or keep_r.sum() * 2 < len(lines):
            cols, lines = cols[keep_a], lines[keep_r]
            part, alive = part[np.ix_(keep_a, keep_r)], alive[np.ix_(keep_a, keep_r)]
    i, j = np.nonzero(alive)
    score, i, j = part[i, j], cols[i], lines[j]
    while k >= 0 and len(i):
        weight = kind(-(1 << k) if k == top else 1 << k)
        for lo in range(0, len(i), TILE * 16):
            hi = lo + TILE * 16
            score[lo:hi] += weight * (a[i[lo:hi]] * ((rows[j[lo:hi]] >> k) & 1).astype(kind)).sum(1)
        rest = kind((1 << k) - 1)
        left = may(i, score + rest * least[i], score + rest * most[i])
        i, j, score = i[left], j[left], score[left]
        k -= 1
    return i, j, score.astype(np.int64)


class Best:
    """The first `size` (score, id) of each of `groups` groups: higher scores first, then smaller ids."""

    def __init__(self, groups: int, size: int):
        self.size = size
        self.group = self.score = self.id = np.zeros(0, np.int64)
        self.floor = np.full(groups, NONE, np.int64)  # the score of the last place, where all are taken

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        g, s, x = (np.concatenate(pair) for pair in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((x, -s, g))
        g, s, x = g[order], s[order], x[order]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        first = place < self.size
        self.group, self.score, self.id = g[first], s[first], x[first]
        full = place == self.size - 1
        self.floor[g[full]] = s[full]


def row_blocks(batches: Iterator[pa.RecordBatch], known: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, label codes (-1: no anchor's label) and component matrices, rows of one length at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TILE):
            part = batch.slice(lo, TILE)
            code = pc.fill_null(pc.index_in(part.column("label"), value_set=pa.array(known, part.column("label").type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = part.column("id").to_numpy()
            lists = part.column("c")
            flat, sizes = lists.flatten().to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy()
            ends = np.cumsum(sizes)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                yield ids[at], code[at], flat[(ends[at] - n)[:, None] + np.arange(n)].reshape(len(at), n)


def scan(batches: Iterator[pa.RecordBatch], anchors: Anchors, found: Best, qualify, label_equal: bool) -> None:
    """Put all rows against the block's anchors, a tile at a time. qualify(anchor places) gives (may, take) of progressive's bounds and of its exact scores."""
    for ids, code, rows in row_blocks(batches, anchors.known):
        if rows.shape[1] not in anchors.widths:
            continue
        places, matrix = anchors.widths[rows.shape[1]]
        for lo in range(0, len(places), TILE):
            at = places[lo : lo + TILE]
            alive = ((anchors.label[at][:, None] == code) == label_equal) & (anchors.ids[at][:, None] != ids)
            may, take = qualify(at)
            i, j, score = progressive(matrix[lo : lo + TILE], rows, alive, may)
            take(at[i], score, ids[j])


def positive_pass(anchors: Anchors, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(len(anchors.ids), size)

        def qualify(at):
            floor = found.floor[at]
            return (lambda a, low, high: high >= floor[a]), found.add

        scan(batches, anchors, found, qualify, True)
        yield pa.record_batch({"a": found.group, "id": found.id, "score": found.score})

    return run


def negative_pass(anchors: Anchors, positive_scores: np.ndarray, size: int, low: int, high: int):
    """positive_scores: anchors by positives, NONE where there is no further positive. Groups are anchor * positives + positive."""
    each = positive_scores.shape[1]
    real = positive_scores != NONE
    whole, rest = np.divmod(positive_scores, 100)  # apart, so that no product leaves 64 bits
    first = np.where(real, low * whole - (-low * rest) // 100, 1 << 62)
    last = np.where(real, high * whole + (high * rest) // 100, NONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(positive_scores.size, size)

        def qualify(at):
            need, limit = np.maximum(first[at], found.floor.reshape(-1, each)[at]), last[at]

            def may(a, lo, hi):
                out = np.zeros(np.broadcast_shapes(np.shape(a), np.shape(lo)), bool)
                for p in range(each):
                    out |= (hi >= need[a, p]) & (lo <= limit[a, p])
                return out

            def take(a, score, ids):
                for p in range(each):
                    fits = (score >= first[a, p]) & (score <= last[a, p])
                    found.add(a[fits] * each + p, score[fits], ids[fits])

            return may, take

        scan(batches, anchors, found, qualify, False)
        yield pa.record_batch({"a": found.group, "id": found.id, "score": found.score})

    return run


def best_of(partial: DataFrame, size: int) -> DataFrame:
    """The first `size` rows of each group with their rank; groups are few rows a task."""
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "id")))
    return ranked.where(F.col("rank") <= size)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchor_every: int = 100, positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, scale: int = 256, block_bytes: int = 8 << 20,
) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score: for each anchor (id divisible by `anchor_every`) and each of its first positives the first rows of other labels with low * positive <= 100 * score <= high * positive."""
    spark = vectors.sparkSession
    rows = materialize(integer_rows(vectors, id_col, vec_col, label_col, scale), "vectors")
    asking = materialize(rows.where(F.col("id") % anchor_every == 0).distinct(), "anchors")
    total = asking.agg(F.sum(F.size("c") * 8 + 64)).first()[0] or 0
    blocks = -(-2 * total // block_bytes) or 1  # by hash, filled to a half, so that a block stays in its bound
    block_of = F.pmod(F.xxhash64("id", "label", "c"), F.lit(blocks))
    sizes = {r["b"]: r["n"] for r in asking.groupBy(block_of.alias("b")).agg(F.sum(F.size("c") * 8 + 64).alias("n")).toLocalIterator()}
    done = []
    for block in sorted(sizes):
        if sizes[block] > 2 * block_bytes:
            raise ValueError(f"an anchor block has {sizes[block]} bytes; block_bytes is too small for vectors of this length")
        own = asking.where(block_of == block).orderBy("id", "label", "c").collect()
        anchors = Anchors(np.array([r["id"] for r in own], np.int64), [r["label"] for r in own], [np.array(r["c"], np.int64) for r in own])
        sent = spark.sparkContext.broadcast(anchors)
        pairs = rows.mapInArrow(lambda it, sent=sent: positive_pass(sent.value, positives)(it), "a long, id long, score long")
        best = best_of(pairs, positives).collect()  # at most `positives` an anchor of the block
        if best:
            scores, ids = np.full((len(own), positives), NONE, np.int64), np.zeros((len(own), positives), np.int64)
            for r in best:
                scores[r["a"], r["rank"] - 1], ids[r["a"], r["rank"] - 1] = r["score"], r["id"]
            known = spark.createDataFrame([(int(a * positives + p), int(anchors.ids[a]), int(ids[a, p]), int(p) + 1, int(scores[a, p])) for a, p in zip(*np.nonzero(scores != NONE), strict=True)], "a long, anchor_id long, positive_id long, positive_rank int, positive_score long")
            pairs = rows.mapInArrow(lambda it, sent=sent, scores=scores: negative_pass(sent.value, scores, negatives, low, high)(it), "a long, id long, score long")
            out = best_of(pairs, negatives).join(known, "a").select("anchor_id", "positive_id", "positive_rank", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            done.append(materialize(out, "negatives"))
        sent.destroy()
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long")
    result = done[0]
    for more in done[1:]:
        result = result.unionAll(more)
    return result
