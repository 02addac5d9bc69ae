"""Line hashing: equal units across the corpus are kept once, at their earliest rank.

Units cover a text: `line` (with its line break), `paragraph` (lines up to an empty one) or, for passages
that begin inside a line, `sentence` (lines cut after `.!?` and their wide forms). A unit is normalised (A-Z
lower-cased, runs of blanks to one space, trimmed) and digested to 16 bytes. Digests are grouped globally
after partial aggregation; units of repeated digests that aren't the earliest (smallest id, then unit
number) are repeats. Repeats are removed and keep their original offsets; what stays is joined again.

`min_words` is the least size of a unit that counts at all. `min_run` is the least number of words in a run
of neighbouring repeats (units without words between them don't break it): with it, passages go and single
common lines stay. Both are off by default, so each repeated unit with a word goes.

Passages begin and end inside lines. With `passage_words`, sentences are digested in the same pass beside the
units, and `passages` has the spans from the first to the last of neighbouring repeated sentences that hold at
least so many words. It is a report: what is removed and kept follows from the units alone.

Defined results: null or empty texts have no units and lose nothing; null ids rank last; rows equal in
id and text are the same document and have the same result; an empty table gives an empty one. A very
long text is handled alone, others in blocks of bounded bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialize
from tessera.llm.bytetext import blocks, small_batches
from tessera.llm.prefilter import only_maybe, split

LAST = (1 << 63) - 1
#: Units as patterns that cover every text.
UNITS = {
    "line": r"[^\n]+\n?|\n",
    "paragraph": r"[^\n]+(?:\n[^\n]+)*\n*|\n+",
    "sentence": r"[^\n.!?。！？]+[.!?。！？]*\n?|[.!?。！？]+\n?|\n",
}


def split_units(text: str, unit: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """Start, end and normalised words of each unit. On bytes, lower() takes A-Z only and split() the blanks 0x20 and 0x09-0x0D."""
    for m in re.finditer(UNITS[unit], text):
        yield m.start(), m.end(), m.group().encode().lower().split()


def _units(batches: Iterator[pa.RecordBatch], kinds: list[str], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in blocks(batches, "text"):
        names = ["digest", "id", "th", "kind", "unit"]
        out: list[list] = [[] for _ in names]
        for i, th, text in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for n, kind in enumerate(kinds):
                for k, (_, _, words) in enumerate(split_units(text or "", kind)):
                    if len(words) >= max(min_words if n == 0 else 1, 1):
                        digest = hashlib.blake2b(b" ".join(words), digest_size=16, person=kind.encode()).digest()  # kinds never meet
                        for column, v in zip(out, (digest, i, th, n, k), strict=True):
                            column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.binary(), pa.int64(), pa.int64(), pa.int8(), pa.int32()], strict=True)], names)


def _runs(own: list[tuple[int, int, list[bytes]]], repeats: set[int], least: int) -> Iterator[list[int]]:
    """Runs of neighbouring repeated units of at least so many words; units without words don't break them."""
    run: list[int] = []
    held = 0
    for k, (_, _, words) in enumerate([*own, (0, 0, [b""])]):
        if k in repeats:
            run.append(k)
            held += len(words)
        elif words:
            if run and held >= least:
                yield run
            run, held = [], 0


def _strip(batches: Iterator[pa.RecordBatch], kinds: list[str], min_run: int, passage_words: int) -> Iterator[pa.RecordBatch]:
    span = [("start", pa.int64()), ("end", pa.int64())]
    for batch, _, _ in blocks(batches, "text"):
        n, kept, removed, passages = [], [], [], []
        for text, repeats in zip(batch.column("text").to_pylist(), batch.column("repeats").to_pylist(), strict=True):
            by_kind: list[set[int]] = [set(), set()]
            for x in repeats or []:
                by_kind[x["kind"]].add(x["unit"])
            if by_kind[0]:
                own = list(split_units(text, kinds[0]))
                gone = [k for run in _runs(own, by_kind[0], min_run) for k in run]
                drop = set(gone)
                n.append(len(own))
                kept.append("".join(text[a:b] for k, (a, b, _) in enumerate(own) if k not in drop))
                removed.append([{"unit": k, "start": own[k][0], "end": own[k][1]} for k in gone])
            else:
                n.append(sum(1 for _ in re.finditer(UNITS[kinds[0]], text or "")))
                kept.append(text)
                removed.append([])
            own = list(split_units(text, "sentence")) if by_kind[1] else []
            passages.append([{"start": own[run[0]][0], "end": own[run[-1]][1]} for run in _runs(own, by_kind[1], passage_words)])
        columns = {"id": batch.column("id"), "n_units": pa.array(n, pa.int64()), "removed": pa.array(removed, pa.list_(pa.struct([("unit", pa.int64()), *span]))), "kept": pa.array(kept, pa.string())}
        yield pa.RecordBatch.from_pydict(columns | ({"passages": pa.array(passages, pa.list_(pa.struct(span)))} if passage_words else {}))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1, min_run: int = 0, passage_words: int = 0) -> DataFrame:
    """id, n_units, removed (unit number, start and end character in the original text) and kept (the text without them) for each row; with `passage_words` also passages (start, end)."""
    small_batches(docs.sparkSession)
    kinds = [unit, "sentence"] if passage_words else [unit]
    if len(set(kinds)) < len(kinds):
        raise ValueError("passages of sentence units are their runs: use min_run")
    slim = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), F.coalesce(F.xxhash64(docs[f"`{text_col}`"]), F.lit(0)).alias("th"), docs[f"`{text_col}`"].alias("text"))
    units = materialize(slim.mapInArrow(lambda b: _units(b, kinds, min_words), "digest binary, id long, th long, kind byte, unit int"), "units")
    rank = F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), "th", "unit")
    firsts = units.groupBy("digest").agg(F.min(rank).alias("keep"), F.max(rank).alias("last")).where("keep <> last").select("digest", "keep")
    firsts = materialize(firsts, "firsts")  # its join has exchanges of its own, so a hot digest can be split
    again = only_maybe(units, firsts, "digest").join(firsts, "digest").where(rank != F.col("keep"))
    repeats = materialize(again.groupBy("id", "th").agg(F.collect_set(F.struct("kind", "unit")).alias("repeats")), "repeats")
    # only texts that may have repeats are shuffled
    some, rest = split(slim, repeats, "id", "th")
    some = some.join(repeats, some["id"].eqNullSafe(repeats["id"]) & (some["th"] == repeats["th"]), "left").select(some["id"], "text", "repeats")
    rest = rest.select("id", "text", F.lit(None).cast("array<struct<kind:tinyint,unit:int>>").alias("repeats"))
    schema = "id long, n_units long, removed array<struct<unit:bigint,start:bigint,end:bigint>>, kept string" + (", passages array<struct<start:bigint,end:bigint>>" if passage_words else "")
    strip = lambda df: df.mapInArrow(lambda b: _strip(b, kinds, min_run, passage_words), schema)
    return strip(rest).unionByName(strip(some))
