"""Benchmark decontamination with an FM-index per training shard.

A shard is a block of documents inside one task. Its words become dense symbols; words outside the
benchmark's vocabulary can be in no window, so they only break the shard into runs. The runs are
suffix-sorted, their Burrows-Wheeler transform is kept as a wavelet matrix of packed bits with rank
blocks, and all windows are searched backwards at once. Occurrences are located by stepping back to
sampled suffix positions, then overlapping ones are merged to removal spans. Nothing is shuffled.

Defined results: null or empty texts have no words, no hits and no spans; null or empty items have no
window; items of equal text are all reported; repeated document rows are judged each on its own; with
an empty benchmark nothing is hit. Words are found by 64-bit hashes and confirmed by their bytes. The benchmark
is read in parts of at most `part_bytes`, one broadcast each; a pass over the documents takes `parts_a_pass` of
them and is written before the next, so neither a broadcast nor the memory of a task grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shared import materialize
from tessera.llm.bytetext import ALNUM, LOWER, blocks, find_words, prefix_hash, small_batches, span_hash

SAMPLE = 8
SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "first_word", "end_word")])
ARROW_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "first_word", "end_word")]))


class RankBits:
    """A bit vector with ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        room = np.zeros((n // 64 + 1) * 8, np.uint8)
        room[: len(packed)] = packed
        self.words = room.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class Wavelet:
    """Ranks of any symbol in an integer sequence, one bit vector a level."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            b = (seq >> bit) & 1
            self.levels.append((bit, RankBits(b.astype(bool)), int(len(seq) - b.sum())))
            seq = np.concatenate([seq[b == 0], seq[b == 1]])

    def rank(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often symbol[i] stands before each of the positions at[..][i]."""
        places = [np.zeros(len(symbol), np.int64), *at]
        for bit, bits, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            ones = [bits.ones(p) for p in places]
            places = [np.where(one, zeros + r, p - r) for p, r in zip(places, ones, strict=True)]
        return [p - places[0] for p in places[1:]]


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; zeros are breaks, each different from all others and ordered by position."""
    n = len(seq)
    breaks = seq == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, int(breaks.sum()) + seq).astype(np.int64)
    step = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, step * 2


class FMIndex:
    def __init__(self, seq: np.ndarray, top: int):
        order = suffix_array(seq)
        self.bwt = seq[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.wavelet = Wavelet(self.bwt, top)
        sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.sampled, self.bits = order[sampled], RankBits(sampled)
        self.is_sampled = sampled

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long patterns (a row each), found backwards; lo == hi where there is none."""
        last = patterns[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        live = np.flatnonzero(hi > lo)
        for col in range(patterns.shape[1] - 2, -1, -1):
            if not len(live):
                break
            c = patterns[live, col]
            a, b = self.wavelet.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.first[c] + a, self.first[c] + b
            live = live[b > a]
        found = np.zeros(len(patterns), bool)
        found[live] = True
        return np.where(found, lo, 0), np.where(found, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.is_sampled[at])
        while len(walk):
            c = self.bwt[at[walk]]
            at[walk] = self.first[c] + self.wavelet.rank(c, at[walk])[0]
            steps[walk] += 1
            walk = walk[~self.is_sampled[at[walk]]]
        return self.sampled[self.bits.ones(at)] + steps


class Phrases:
    """Windows of a part of the benchmark: vocabulary by hash, and for each length a matrix of symbols with its items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        data, offs = _joined([t for _, t in items])
        s, e, at = find_words(ALNUM, LOWER[data], offs)
        hashes = span_hash(prefix_hash(LOWER[data]), s, e)
        self.vocabulary, one, symbol = np.unique(hashes, return_index=True, return_inverse=True)
        symbol = symbol + 1
        raw, bounds = LOWER[data].tobytes(), list(zip(s.tolist(), e.tolist(), strict=True))
        self.words = [raw[slice(*bounds[i])] for i in one.tolist()]
        if any(raw[a:b] != self.words[k - 1] for (a, b), k in zip(bounds, symbol.tolist(), strict=True)):
            raise ValueError("two words of the benchmark have one hash")
        self.ids = [k for k, _ in items]
        by_length: dict[int, dict[tuple, list[int]]] = {}
        for i in range(len(items)):
            own = tuple(symbol[at[i] : at[i + 1]].tolist())
            if own:
                size = min(width, len(own))
                for k in range(len(own) - size + 1):
                    at_window = by_length.setdefault(size, {}).setdefault(own[k : k + size], [])
                    if at_window[-1:] != [i]:
                        at_window.append(i)
        self.shortest = min(by_length, default=0)
        self.windows = [(np.array(list(w), np.int64), list(w.values())) for _, w in sorted(by_length.items())]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)


def search_shard(phrases: Phrases, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first words, lengths, lengths' group, windows in the group) of all occurrences among a shard's words."""
    none = np.zeros(0, np.int64)
    if not phrases.shortest or not len(symbols):
        return none, none, none, none
    known = symbols > 0
    begin = known & np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])])
    end = known & np.concatenate([~known[1:] | (doc[1:] != doc[:-1]), [True]])
    lo, hi = np.flatnonzero(begin), np.flatnonzero(end) + 1
    keep = hi - lo >= phrases.shortest
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return none, none, none, none
    # each run stands after a break, and a break ends the sequence
    size = hi - lo + 1
    starts = np.cumsum(size) - size
    word = np.arange(int(size.sum())) - np.repeat(starts, size) + np.repeat(lo, size) - 1
    seq = np.zeros(len(word) + 1, np.int64)
    seq[:-1] = symbols[np.maximum(word, 0)]
    seq[starts] = 0
    index = FMIndex(seq, len(phrases.vocabulary))
    found = []
    for group, (patterns, _) in enumerate(phrases.windows):
        a, b = index.search(patterns)
        n = b - a
        if total := int(n.sum()):
            which = np.repeat(np.arange(len(patterns)), n)
            rows = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            found.append((word[index.locate(rows)], np.full(total, patterns.shape[1]), np.full(total, group), which))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none, none)


def confirmed(phrases: Phrases, symbols: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray, found: tuple) -> tuple:
    """The occurrences of which every word is the benchmark's, byte for byte."""
    word, length = found[0], found[1]
    if not len(word):
        return found
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + length, -1)
    bad = np.zeros(len(s) + 1, np.int64)
    for i in np.flatnonzero(np.cumsum(cover[:-1]) > 0).tolist():
        bad[i + 1] = data[s[i] : e[i]].tobytes() != phrases.words[symbols[i] - 1]
    bad = np.cumsum(bad)
    good = bad[word + length] == bad[word]
    return tuple(x[good] for x in found)


def _scan(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    for batch, raw, offs in blocks(batches, "text"):
        data = LOWER[raw]
        s, e, at = find_words(ALNUM, data, offs)
        n = batch.num_rows
        doc = np.repeat(np.arange(n), np.diff(at))
        symbols = phrases.symbols(span_hash(prefix_hash(data), s, e))
        word, length, group, window = confirmed(phrases, symbols, data, s, e, search_shard(phrases, symbols, doc))
        cover = np.zeros(len(s) + 1, np.int64)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + length, -1)
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        if len(word):
            hit = np.cumsum(cover[:-1]) > 0
            begin = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (doc[1:] != doc[:-1])]))
            end = np.flatnonzero(hit & np.concatenate([~hit[1:] | (doc[1:] != doc[:-1]), [True]])) + 1
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                d = int(doc[a])
                spans[d] = [*(spans[d] or []), {"start": int(s[a] - offs[d]), "end": int(e[b - 1] - offs[d]), "first_word": int(a - at[d]), "end_word": int(b - at[d])}]
            pairs = np.unique(np.stack([doc[word], group, window], 1), axis=0)
            more: dict[int, set[str]] = {}
            for d, g, w in pairs.tolist():
                more.setdefault(d, set()).update(phrases.ids[i] for i in phrases.windows[g][1][w])
            for d, ids in more.items():
                spans[d] = merge_spans(spans[d])
                items[d] = sorted({*(items[d] or []), *ids})
        out = {f.name: batch.column(f.name) for f in batch.schema}
        out |= {"n_words": pa.array(np.diff(at), pa.int64()), "spans": pa.array([x or [] for x in spans], ARROW_SPANS), "items": pa.array([x or [] for x in items], pa.list_(pa.string()))}
        yield pa.RecordBatch.from_pydict(out)


def merge_spans(spans: list[dict]) -> list[dict]:
    """Overlapping or touching spans become one."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: x["first_word"]):
        if out and x["first_word"] <= out[-1]["end_word"]:
            if x["end_word"] > out[-1]["end_word"]:
                out[-1] = out[-1] | {"end": x["end"], "end_word": x["end_word"]}
        else:
            out.append(x)
    return out


def _parts(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int) -> Iterator[list[tuple[str, str]]]:
    part, size = [], 0
    for k, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        if part and size + len(text.encode()) > part_bytes:
            yield part
            part, size = [], 0
        part.append((k, text))
        size += len(text.encode())
    yield part


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", width: int = 10, part_bytes: int = 16 << 20, parts_a_pass: int = 4) -> DataFrame:
    """`row` (struct of the kept input columns, all by default), n_words, spans (merged; byte offsets in the text and word numbers) and items (sorted ids as strings), for each row of docs."""
    keep = docs.columns if keep is None else keep
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[text_col].alias("text"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(T.ArrayType(SPAN)).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    for k, part in enumerate(_parts(benchmark, item_id, item_text, part_bytes)):
        if k and k % parts_a_pass == 0:
            out = materialize(out, "scanned")
        shared = sc.broadcast(Phrases(part, width))
        out = out.mapInArrow(lambda batches, shared=shared: _scan(batches, shared.value), out.schema)
    return out.select("row", "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the text of the removal spans; all other columns and rows stay. `n_chars`, where there is one, follows the text."""
    found = find_contamination(docs, benchmark, text_col, **options)
    raw = F.col(f"row.`{text_col}`").cast("binary")
    # from the end of each span to the start of the next, and before the first
    ends = F.concat(F.array(F.lit(0)), F.col("spans.end"))
    kept = F.transform(ends, lambda a, i: F.substring(raw, a + 1, F.coalesce(F.get(F.col("spans.start"), i), F.octet_length(raw)) - a))
    clean = F.when(F.size("spans") > 0, F.array_join(F.transform(kept, lambda x: F.decode(x, "UTF-8")), "")).otherwise(F.col(f"row.`{text_col}`"))
    columns = []
    for name, kind in docs.dtypes:
        if name == text_col:
            columns.append(clean.alias(name))
        elif name == "n_chars":
            columns.append(F.when(F.size("spans") > 0, F.char_length(clean)).otherwise(F.col("row.n_chars")).cast(kind).alias(name))
        else:
            columns.append(F.col(f"row.`{name}`").alias(name))
    return found.select(*columns)
