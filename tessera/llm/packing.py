"""Packing token ids into sequences: cutting-stock column generation over the histogram of lengths.

Every document's ids, with an end id, are cut into pieces of the sequence length; its last piece is shorter. How
many pieces there are of each length (at most `capacity` numbers) is all the driver sees. A pattern is a multiset
of lengths that fills a sequence exactly. The linear program chooses how often each pattern is used so that as few
tokens as possible are left over; patterns are generated as columns: the duals price lengths, and a knapsack by
dynamic programming finds the pattern of highest value. Counts are rounded down, and further patterns are
filled from what remains. What no pattern takes is laid end to end and cut where a sequence is full, and what is
left at the end of this is cut into powers of two. So there is no padding, and few documents are cut that fit.

Pieces of equal length are ranked: a task numbers its own, and counts of (length, task) are summed over tasks. A
rank tells the pattern, sequence and place by a search in a table whose size is bounded by `capacity`. Neither
a length nor a document's pieces ever meet in one task.

Ids are those of the whole text. It is cut into segments where no match of a byte-level vocabulary's usual pattern
can cross (`segment_starts`); distinct segments are encoded once a block of text. Other tokenizers encode whole texts.

Defined results: null and empty texts have the end id only; repeated rows are packed each; a very long text is a
block of its own; an empty table gives no pieces. Further columns may have any names.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tessera.functions.shared import materialize
from tessera.llm.bytetext import blocks, small_batches

END_ID = 0
#: Kinds of characters; SOLID ones are only known not to be blank.
UNKNOWN, L, DIGIT, SIGN, APOSTROPHE, SOLID, BLANK, BREAK = range(8)
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = L
KIND[0x30:0x3A] = DIGIT
KIND[0x27], KIND[0x20], KIND[0x09:0x0E] = APOSTROPHE, BLANK, BREAK
#: Segments kept between blocks, and the longest of them; these change speed only.
KEPT, KEPT_LENGTH = 1_000_000, 40


def added_tokens(spec: str) -> list[bytes]:
    return [a["content"].encode() for a in json.loads(spec).get("added_tokens", [])]


def splits_by_kind(spec: str) -> bool:
    """Whether a tokenizer file is byte-level with its usual pattern, whose matches segment_starts knows."""
    t = json.loads(spec)
    pre = t.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not t.get("normalizer") and not t.get("truncation")
    return plain and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in t.get("added_tokens", []))


@functools.lru_cache(maxsize=2)
def tokenizer(spec: str):
    """A tokenizer and the segments known so far, kept in a process: loading takes longer than a block, and one worker process runs many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec), {}


def segment_starts(data: np.ndarray, offs: np.ndarray, whole: list[bytes] = ()) -> np.ndarray:
    """Starts of texts that aren't empty, and places between two characters that the pattern never takes into one
    match, whatever stands around them: a blank after a character that is none; a change between letters, digits and
    signs, but for what follows an apostrophe; and what follows a single line break or tab.

    Characters whose kind isn't known from their bytes alone (most outside ASCII but for Latin and Cyrillic letters)
    are left uncut. `whole` are strings, the added tokens, that aren't cut inside.
    """
    kind = KIND[data]
    lead, low = data[:-1], data[1:]
    second = (lead == 0xC3) & (low != 0x97) & (low != 0xB7) | (lead == 0xD0) | (lead == 0xD1)  # of a two-byte letter
    kind[1:][second] = L
    kind[:-1][second] = L
    # U+00D7 to U+07FF but for these letters, and U+4000 to U+CFFF, hold no blanks
    kind[1:][(lead >= 0xC3) & (lead <= 0xDF) & ~second] = SOLID
    kind[2:][(data[:-2] >= 0xE4) & (data[:-2] <= 0xEC)] = SOLID
    before, here = kind[:-1], kind[1:]
    solid, blank = (kind >= L) & (kind <= SOLID), kind >= BLANK
    cut = np.zeros(len(data), bool)
    cut[1:] = blank[1:] & solid[:-1]
    cut[1:] |= (before == L) & (here >= DIGIT) & (here <= APOSTROPHE)
    cut[1:] |= (before == DIGIT) & ((here == L) | (here == SIGN) | (here == APOSTROPHE))
    cut[1:] |= (before == SIGN) & ((here == L) | (here == DIGIT))
    cut[2:] |= (before[1:] == BREAK) & solid[:-2] & (here[1:] >= L) & (here[1:] <= APOSTROPHE)
    raw = data.tobytes() if whole else b""
    for token in whole:
        at = raw.find(token)
        while at >= 0:
            cut[at + 1 : at + len(token)] = False
            at = raw.find(token, at + 1)
    first = offs[:-1][np.diff(offs) > 0]
    after = first + 1
    cut[after[after < len(data)]] &= kind[first[after < len(data)]] != BREAK  # what stands before it is another text
    cut[first] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of the texts of a block, each followed by the end id."""

    def __init__(self, spec: str, cut: bool):
        self.model, self.known = tokenizer(spec)
        self.cut, self.whole = cut, added_tokens(spec)

    def segments(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all distinct segments end to end, and their numbers."""
        if len(self.known) > KEPT:
            self.known.clear()
        known = self.known
        fresh = [s for s in distinct if s not in known]
        for s, e in zip(fresh, self.model.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            known[s] = array("I", e.ids).tobytes()
        found = [known[s] for s in distinct]
        for s in fresh:
            if len(s) > KEPT_LENGTH:
                del known[s]
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more entry at the end)."""
        texts = len(offs) - 1
        starts = segment_starts(data, offs, self.whole) if self.cut else offs[:-1][np.diff(offs) > 0]
        bounds = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        flat, sizes = self.segments(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy() if len(starts) else np.zeros(0, np.int64)
        begins = np.cumsum(sizes) - sizes
        per = sizes[at]
        upto = np.append(0, np.cumsum(per))
        counts = np.diff(upto[np.searchsorted(starts, offs)])  # of a text without its end id
        ids = np.full(int(upto[-1]) + texts, END_ID, "<u4")
        ids[np.arange(upto[-1]) + np.repeat(np.arange(texts), counts)] = flat[np.arange(upto[-1]) + np.repeat(begins[at] - upto[:-1], per)]
        return ids, np.append(0, np.cumsum(counts + 1))


def cut_pieces(docs: DataFrame, text_col: str, keep: list[str], spec: str, capacity: int) -> DataFrame:
    """row, doc_tokens, start, length, ids (little-endian unsigned 32 bits), their crc, part and k: the k-th piece of its length in the task."""
    sent, cut = docs.sparkSession.sparkContext.broadcast(spec), splits_by_kind(spec)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{text_col}`"].alias("text"))
    schema = StructType([packed.schema["row"], *[StructField(c, LongType()) for c in ("doc_tokens", "start", "length", "crc")], StructField("part", IntegerType()), StructField("k", LongType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(sent.value, cut), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, data, offs in blocks(batches, "text"):
            ids, begins = encoder.block(data, offs)
            tokens = np.diff(begins)
            n = -(-tokens // capacity)
            of = np.repeat(np.arange(len(n)), n)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(tokens[of] - start, capacity)
            order = np.argsort(length, kind="stable")
            rank = np.empty(len(of), np.int64)
            rank[order] = np.arange(len(of)) - np.searchsorted(length[order], length[order])
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            ends = np.append(begins[of] + start, len(ids)) * 4
            raw = memoryview(ids).cast("B")
            crc = np.array([zlib.crc32(raw[lo:hi]) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.int64)
            column = pa.BinaryArray.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.record_batch([batch.column("row").take(pa.array(of)), pa.array(tokens[of]), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(of), part, np.int32)), pa.array(rank), column], schema.names)

    return packed.mapInArrow(run, schema)


def best_pattern(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The exact fill of highest total price, copies unbounded: its value and its copies of each length."""
    best, pick = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    best[0] = 0
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        if n := upto[c]:
            value = best[c - lengths[:n]] + prices[:n]
            pick[c] = value.argmax()
            best[c] = value[pick[c]]
    out, c = np.zeros(len(lengths), np.int64), capacity
    while c and best[capacity] > -np.inf:
        out[pick[c]] += 1
        c -= lengths[pick[c]]
    return float(best[capacity]), out


def fill(there: np.ndarray, capacity: int) -> list[int] | None:
    """Lengths that fill a sequence exactly, beginning with the longest there; the last two are searched, those between are taken longest first."""
    longest = there.nonzero()[0]
    taken, gap = [int(longest[-1])], capacity - int(longest[-1])
    while gap:
        if there[gap]:
            return [*taken, gap]
        pair = there[1:gap] & there[1:gap][::-1]
        if pair.any():
            x = int(pair.nonzero()[0][-1]) + 1
            return [*taken, x, gap - x]
        fitting = longest[: np.searchsorted(longest, gap, "right")]
        if not len(fitting):
            return None
        taken.append(int(fitting[-1]))
        gap -= int(fitting[-1])
    return taken


def patterns(counts: dict[int, int], capacity: int, rounds: int = 300, left_share: float = 1e-3) -> list[tuple[dict[int, int], int]]:
    """(copies of each length, how often) of the patterns to use; all fill a sequence exactly, none takes more pieces than there are.

    The basis begins with one column a length, a pattern or the length alone as left over, each found for a length
    that later columns don't hold, so it is triangular. A round prices and brings in one pattern. Rounds end at the
    optimum, when less than `left_share` of the tokens are left over, or at `rounds`; any end is a valid plan.
    """
    lengths = np.array(sorted(x for x in counts if x < capacity), np.int64)
    m, at = len(lengths), {int(x): i for i, x in enumerate(lengths)}
    plan = [({capacity: 1}, counts[capacity])] if counts.get(capacity) else []
    if not m:
        return plan
    demand = np.array([counts[int(x)] for x in lengths], np.float64)
    loose = 1.1 * lengths / capacity  # cost of a piece that is left over; a pattern costs 1

    def column(pieces: list[int]) -> np.ndarray:
        return np.bincount([at[x] for x in pieces], minlength=m).astype(np.float64)

    there, left = np.zeros(capacity + 1, bool), demand.copy()
    there[lengths] = True
    basis, inverse, cost, alone = np.zeros((m, m)), np.zeros((m, m)), np.ones(m), np.zeros(m)
    for j in range(m):
        pieces = fill(there, capacity)
        a = column(pieces or [int(there.nonzero()[0][-1])])
        used = a > 0
        i = int(np.flatnonzero(used)[np.argmin(left[used] / a[used])])
        left -= a * (left[i] / a[i])
        there[lengths[i]] = False
        # earlier columns may hold length i, later ones don't: forward substitution gives the inverse's line
        inverse[j, i] = 1.0
        for e in np.flatnonzero(basis[i, :j]):
            inverse[j] -= basis[i, e] * inverse[e]
        inverse[j] /= a[i]
        basis[:, j] = a
        if not pieces:
            cost[j], alone[j] = loose[i], lengths[i]
    total = float((lengths * demand).sum())
    # einsum, as the driver's threads of a linear algebra library can hang once the process has forked
    solve = lambda: np.einsum("ij,j->i", inverse, demand)
    for _ in range(rounds):
        x = solve()
        if float((x * alone).sum()) <= left_share * total:
            break
        value, a = best_pattern(np.einsum("i,ij->j", cost, inverse), lengths, capacity)
        if value <= 1 + 1e-9:
            break
        step = np.einsum("ij,j->i", inverse, a)
        grows = step > 1e-9
        if not grows.any():
            break
        out = int(np.flatnonzero(grows)[np.argmin(np.maximum(x[grows], 0) / step[grows])])
        inverse[out] /= step[out]
        step[out] = 0
        inverse -= step[:, None] * inverse[out]
        basis[:, out], cost[out], alone[out] = a, 1.0, 0.0
    x = solve()
    remaining = demand.astype(np.int64)
    chosen: dict[tuple, int] = {}

    def take(a: np.ndarray, most: int) -> int:
        a = a.astype(np.int64)
        n = min(most, int((remaining[a > 0] // a[a > 0]).min()))
        if n > 0:
            remaining[:] -= n * a
            key = tuple((int(i), int(a[i])) for i in np.flatnonzero(a))
            chosen[key] = chosen.get(key, 0) + n
        return n

    whole = np.floor(x + 1e-6).astype(np.int64)
    real = [int(j) for j in np.flatnonzero(alone == 0)]
    for j in real:
        take(basis[:, j], int(whole[j]))
    for j in sorted(real, key=lambda j: whole[j] - x[j]):
        take(basis[:, j], 1)
    there[:] = False
    there[lengths] = remaining > 0
    while there.any():  # what remains is a few pieces a pattern
        pieces = fill(there, capacity)
        if not pieces or not take(column(pieces), 1 << 62):
            there[there.nonzero()[0][-1]] = False
        else:
            there[lengths] &= remaining > 0
    return plan + [({int(lengths[i]): n for i, n in key}, times) for key, times in sorted(chosen.items())]


class Places:
    """Where the r-th piece of a length goes. Sequences of patterns come first, then those of the left over."""

    def __init__(self, plan: list[tuple[dict[int, int], int]], counts: dict[int, int], capacity: int):
        self.capacity = capacity
        used, rows, self.sequences = np.zeros(capacity + 1, np.int64), [], 0
        for pattern, times in plan:
            offset = 0
            for x, n in sorted(pattern.items(), reverse=True):
                rows.append((x, used[x], self.sequences, n, offset))
                used[x] += n * times
                offset += n * x
            self.sequences += times
        self.used = used
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        loose = np.array([counts.get(x, 0) for x in range(capacity + 1)], np.int64) - used
        sizes = loose * np.arange(capacity + 1)
        self.before = np.cumsum(sizes) - sizes
        self.total = int(sizes.sum())

    def patterned(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces with rank < used[length]."""
        key = self.table[:, 0] << 44 | self.table[:, 1]
        row = self.table[np.searchsorted(key, length << 44 | rank, "right") - 1]
        within = rank - row[:, 1]
        return row[:, 2] + within // row[:, 3], row[:, 4] + within % row[:, 3] * length

    def cuts(self, lo: int, hi: int) -> list[tuple[int, int, int, int]]:
        """(begin, end, sequence, offset) of the parts of what lies from lo to hi in the left over."""
        full, out = self.total // self.capacity * self.capacity, []
        tail, bounds = self.total - full, [full]
        while tail:
            bounds.append(bounds[-1] + (1 << tail.bit_length() - 1))
            tail -= 1 << tail.bit_length() - 1
        while lo < hi:
            if lo < full:
                first, sequence = lo // self.capacity * self.capacity, lo // self.capacity
                end = first + self.capacity
            else:
                i = int(np.searchsorted(bounds, lo, "right"))
                first, end, sequence = bounds[i - 1], bounds[i], full // self.capacity + i - 1
            out.append((lo, min(hi, end), self.sequences + sequence, lo - first))
            lo = min(hi, end)
        return out


def place(ranked: DataFrame, places: Places) -> DataFrame:
    """sequence_id and offset of each piece; loose_at instead for pieces that no pattern takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            loose = rank >= places.used[length]
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            sequence[~loose], offset[~loose] = places.patterned(length[~loose], rank[~loose])
            at = places.before[length] + (rank - places.used[length]) * length
            yield pa.record_batch([*batch.columns, pa.array(sequence, mask=loose), pa.array(offset, mask=loose), pa.array(at, mask=~loose)], [*batch.schema.names, "sequence_id", "offset", "loose_at"])

    return ranked.mapInArrow(run, StructType([*ranked.schema.fields, *[StructField(c, LongType()) for c in ("sequence_id", "offset", "loose_at")]]))


def cut_loose(loose: DataFrame, places: Places) -> DataFrame:
    """Pieces laid end to end at loose_at, cut where sequences end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for i, (at, length, start, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("loose_at", "length", "start", "ids")), strict=True)):
                for lo, hi, sequence, offset in places.cuts(at, at + length):
                    part = ids[4 * (lo - at) : 4 * (hi - at)]
                    of.append(i)
                    out.append((start + lo - at, hi - lo, zlib.crc32(part), sequence, offset, part))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, [pa.int64()] * 5 + [pa.binary()], strict=True)]
            rows = pa.array(of, pa.int64())
            yield pa.record_batch([batch.column("row").take(rows), batch.column("doc_tokens").take(rows), *columns], ["row", "doc_tokens", "start", "length", "crc", "sequence_id", "offset", "ids"])

    fields = [loose.schema["row"], *[StructField(c, LongType()) for c in ("doc_tokens", "start", "length", "crc", "sequence_id", "offset")], StructField("ids", BinaryType())]
    return loose.mapInArrow(run, StructType(fields))


def pack(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None, capacity: int = 1024, rounds: int = 300, with_ids: bool = True) -> DataFrame:
    """A row a piece: row (the kept columns; all but the text by default), doc_tokens, start, length, crc (of the ids), sequence_id, offset and, if asked, ids (little-endian unsigned 32 bits)."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    names = [c for c in docs.columns if c != text_col] if keep is None else keep
    pieces = materialize(cut_pieces(docs, text_col, names, spec, capacity), "pieces", compression="zstd")
    counted = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(patterns(counts, capacity, rounds), counts, capacity)
    before = counted.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.drop("ids").join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("k")).drop("before")
    placed = materialize(place(ranked, places), "placed")
    columns = ["row", "doc_tokens", "start", "length", "crc", "sequence_id", "offset"]
    with_loose = placed.where("loose_at IS NOT NULL").select("part", "length", "k", "loose_at").join(pieces, ["part", "length", "k"])
    loose = cut_loose(with_loose.select("row", "doc_tokens", "start", "length", "loose_at", "ids"), places)
    whole = placed.where("loose_at IS NULL")
    if not with_ids:
        return whole.select(*columns).unionByName(loose.drop("ids"))
    whole = whole.select("part", "length", "k", "sequence_id", "offset").join(pieces, ["part", "length", "k"])
    return whole.select(*columns, "ids").unionByName(loose)
