"""Count-only Viterbi for unigram vocabularies.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character, longest first; the
dynamic program carries only the best score and its piece count, no back pointers. Ties go as in the
tokenizer: a later candidate must be strictly better, and candidates come in order of their start, so
among equals the longest piece wins. A character that is no piece scores the least score minus 10; it
counts its UTF-8 bytes with byte fallback, else each run of such characters counts once.

Texts are normalised as the model file says (`keeps_blanks`). A model that removes extra blanks puts one
marker U+2581 before each word (a run of characters other than space and U+0009 to U+000D). A model that
keeps them has a marker for each space and one more in front of the text; other blanks stay as they are,
so a line break or tab that is in no piece is an unknown character, and a word after it has no marker.

Pieces hold the marker only in front, so words, or segments of spaces and the word after them, are
independent and are solved once per task. So are runs of blanks that are in no piece, with byte fallback.
Where this doesn't hold, and without kept blanks where a text itself holds the marker, the text is solved
as a whole. The cache is emptied at `cache_words` entries, which changes speed only.

Defined results: null, empty and blank texts have no words and no tokens; repeated rows are counted
each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytetext import blocks, small_batches

MARK = "▁"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
UNKNOWN_PENALTY = 10.0


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def keeps_blanks(path: str) -> bool:
    """Whether a sentencepiece model's normaliser keeps blank runs, line breaks and tabs."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.remove_extra_whitespaces:
        return False
    if spec.precompiled_charsmap or not spec.add_dummy_prefix or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("a normaliser that keeps blanks must map no characters and put one marker in front")
    return True


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool, cache_words: int, keep_blanks: bool = False):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.empty = not vocabulary
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes, self.room = byte_fallback, cache_words
        self.cache: dict[str, tuple[int, float]] = {}
        self.keep_blanks, self.segments = keep_blanks, {}
        # a run of unknown characters counts once without byte fallback, so it mustn't be cut
        self.whole = any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary) or not (byte_fallback or any(piece == MARK for piece, _ in vocabulary))
        apart = "".join(c for c in "\t\n\v\f\r" if byte_fallback and not any(c in piece for piece, _ in vocabulary))
        self.segment = re.compile(rf" *[^ {apart}]+| +" + (rf"|[{apart}]+" if apart else ""))

    def solve(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        open_run = [False] * (n + 1)  # the best way here ends in an unknown character
        at, none = 0, float("-inf")
        best, best_count, single = none, 0, False

        def close(end: int, best: float, best_count: int, single: bool) -> None:
            run = False
            if not single:
                s = score[end - 1] + self.unknown
                if s > best:
                    best, run = s, True
                    best_count = count[end - 1] + (len(text[end - 1].encode()) if self.bytes else int(not open_run[end - 1]))
            score[end], count[end], open_run[end] = best, best_count, run

        for end, (size, own) in () if self.empty else self.automaton.iter(text):
            end += 1
            while at < end - 1:
                at += 1
                close(at, best, best_count, single)
                best, best_count, single = none, 0, False
            s = score[end - size] + own
            if s > best:
                best, best_count = s, count[end - size] + 1
            single |= size == 1
        while at < n:
            at += 1
            close(at, best, best_count, single)
            best, best_count, single = none, 0, False
        return count[n], score[n]

    def word(self, w: str) -> tuple[int, float]:
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) >= self.room:
                self.cache.clear()
            got = self.cache[w] = self.solve(MARK + w)
        return got

    def kept(self, text: str) -> tuple[int, int, float]:
        """Words, tokens, score of a text whose blanks are kept."""
        if not text:
            return 0, 0, 0.0
        spaced = " " + text.replace(MARK, " ")  # the tokenizer tells no marker in the text from a space
        if self.whole:
            return (len(WORD.findall(text)), *self.solve(spaced.replace(" ", MARK)))
        words, tokens, total = 0, 0, 0.0
        for x in self.segment.findall(spaced):
            got = self.segments.get(x)
            if got is None:
                if len(self.segments) >= self.room:
                    self.segments.clear()
                got = self.segments[x] = (len(WORD.findall(x)), *self.solve(x.replace(" ", MARK)))
            words += got[0]
            tokens += got[1]
            total += got[2]
        return len(WORD.findall(text)) if MARK in text else words, tokens, total

    def text(self, text: str) -> tuple[int, int, float]:
        """Words, tokens, score."""
        if self.keep_blanks:
            return self.kept(text)
        words = WORD.findall(text)
        if MARK in text:
            return (len(words), *self.solve("".join(MARK + w for w in words)))
        tokens, total = 0, 0.0
        for w in words:
            got = self.cache.get(w) or self.word(w)
            tokens += got[0]
            total += got[1]
        return len(words), tokens, total


def _count(batches: Iterator[pa.RecordBatch], vocabulary: list[tuple[str, float]], byte_fallback: bool, cache_words: int, keep_blanks: bool) -> Iterator[pa.RecordBatch]:
    counter = Counter(vocabulary, byte_fallback, cache_words, keep_blanks)
    for batch, _, _ in blocks(batches, "text"):  # texts of bounded bytes, or one long text, are held as strings
        found = [counter.text(t or "") for t in batch.column("text").to_pylist()]
        w, t, s = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "n_words": pa.array(w, pa.int64()), "n_tokens": pa.array(t, pa.int64()), "score": pa.array(s, pa.float64())})


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text_col: str = "text", keep: list[str] | None = None, byte_fallback: bool = True, cache_words: int = 400_000, keep_blanks: bool = False) -> DataFrame:
    """`row` (struct of the kept input columns), n_words, n_tokens and score of the best segmentation. A vocabulary is a fixed table of a tokenizer, so it is sent to every task; more than 2,000,000 pieces are refused."""
    if len(vocabulary) > 2_000_000:
        raise ValueError("vocabulary too large to send to every task")
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = rows.select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(lambda b: _count(b, shared.value, byte_fallback, cache_words, keep_blanks), schema)
