"""Vectorised work on the UTF-8 bytes of many texts at once: words, hashes, sliding minima.

Texts arrive as Arrow string columns and are handled in blocks of bounded bytes, so memory follows
the block (or the single longest text), never the batch or the partition. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLOCK = 2 << 20


def small_batches(spark, rows: int = 1000) -> None:
    """Arrow batches of fewer rows for this session, where it has the default of 10,000: texts can be long, and JVM and Python each hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def batch_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, np.uint8)
    return raw, o - o[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of each batch with at most `limit` bytes of text, or one text if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = batch_text(batch.column(column))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            hi = min(hi, n)
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """BASE**i and BASE**-i modulo 2**64, kept between calls in a process but never sent along with a function."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __reduce__(self):
        return Powers, ()

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            made = []
            for base in (BASE, inverse):
                p = np.full(max(n, 1 << 16), base, np.uint64)
                p[0] = 1
                np.multiply.accumulate(p, out=p)
                made.append(p)
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_KEPT = Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _KEPT.get(n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] equal to BASE**i times the polynomial hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes."""
    down = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def find_words(member: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in `member` (256 booleans) within each text, and for each text the index of its first word (one more entry at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    start[cut] = inside[1:-1][cut]
    end[cut - 1] = inside[1:-1][cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def members(pattern_bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`, and of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
SPACED = members(b for b in range(256) if b != 0x20 and not 9 <= b <= 13)
ALNUM = members([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the position of the smallest of values[i:i+width], the leftmost of equals (by the upper 40 bits)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    key = (values & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    if n >= 1 << 24:
        raise ValueError("block too long for window_argmin")
    rows = -(-n // width)
    full = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = key
    grid = full.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    best = np.minimum(right[: n - width + 1], left[width - 1 : n])
    return (best & np.uint64(0xFFFFFF)).astype(np.int64)
