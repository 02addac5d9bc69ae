"""Quality rules as a short-circuit cascade, in built-in functions only.

Every rule is a rejecting predicate over measures of a text. On a sample of about `sample_rows` rows, drawn
from the whole table, each rule is run by itself: the share it rejects and the seconds it takes (less those
of an idle pass) are measured. Rules then stand in descending order of rejection per second inside one CASE,
which evaluates a rule only for rows that all earlier ones passed. Only the order, and so `rejected_by`,
depends on the sample; verdicts don't.

`select_kept` has no counts to return: a text is cut into words, and each further measure is computed only
if a rule that asks for it is reached. `judge` returns the counts of every row; there the rules that need
more than counts are what a rejection saves.

Defined results: a null text has no words and counts of zero; it fails the base rules, as an empty one
does. Repeated rows are judged each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialize

SYMBOLS = r"[#*$%&|<>]+"
#: A line with a word. It begins at a line's start only and gives back no blanks, so long runs of blanks cost their length once.
LINE = r"(?<![^\n])[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D][^\n]*"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _removed(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def windows(w: Column) -> Column:
    """Hashes of the 3-word windows."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


FEW = 16


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more. Where no hash comes twice there are none; else sorted hashes tell which windows repeat, and their places, in order, each add the words not yet counted.

    Few repeated hashes are looked up; with more of them, hashes are sorted together with their places.
    """
    twice = lambda g: let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i - 1), F.lit(False)))))
    paired = lambda g: F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda p, x, i: F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False))
    many = lambda g: let(paired(g), lambda p: F.sort_array(F.transform(F.filter(p, lambda x, i: same(p, x, i)), lambda x: x["i"])))
    few = lambda g, d: F.filter(F.transform(g, lambda h, i: F.when(F.array_contains(d, h), i)), lambda i: i.isNotNull())
    added = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    count = lambda g, d: F.when(F.size(d) == 0, 0).when(F.size(d) <= FEW, let(few(g, d), added)).otherwise(let(many(g), added))
    return let(windows(w), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(twice(g), lambda d: count(g, d))))


class Measures:
    """What rules ask of one text, each computed only where it's asked for: from the words, an array that is there already."""

    def __init__(self, text: Column, w: Column):
        self.text, self.w = text, w

    n_words = property(lambda self: F.size(self.w).cast("long"))
    word_chars = property(lambda self: F.aggregate(self.w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)))
    n_symbols = property(lambda self: _removed(self.text, SYMBOLS).cast("long"))
    n_dup_lines = property(lambda self: let(self.lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    n_repeat_words = property(lambda self: repeat_words(self.w).cast("long"))
    lines = property(lambda self: F.regexp_extract_all(self.text, F.lit(LINE), 0))


class Counted(Measures):
    """The same where the counts are finished columns."""

    def __init__(self, text: Column):
        self.text = text

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = (property(lambda self, n=n: F.col(n)) for n in COUNTS)


def counts(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text, as a struct."""
    text = F.coalesce(text, F.lit(""))
    return let(words(text), lambda w: F.struct(*[getattr(Measures(text, w), n).alias(n) for n in COUNTS]))


def with_counts(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The kept columns and the counts. A generator yields them, so that later filters use them and don't compute them again."""
    return docs.select(*keep, F.inline(F.array(counts(F.col(text_col)))))


@dataclass(frozen=True)
class Rule:
    """`rejects` is asked of a text's Measures, and says the same as `sql` over the counts, the text t and lines (those with a word)."""

    name: str
    rejects: Callable[[Measures], Column]
    sql: str
    covers: str = ""  # a base rule that rejects no text that this one doesn't


def share_of_lines(m: Measures, ends: Callable[[Column], Column], num: int, den: int) -> Column:
    return let(m.lines, lambda x: F.size(F.filter(x, ends)) * den > F.size(x) * num)


BULLETS, DOTS = ("-", "*", "•"), ("...", "…")
#: Words with a letter.
LETTERED = r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*"
#: As many matches as LETTERED has, each of a word up to its first letter: linear in long words without any.
FIRST_LETTER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}"
BASE = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
#: The base as rules of their own, for cascades without finished counts.
BASE_RULES = (Rule("few_words", lambda m: m.n_words < 50, "n_words < 50"), Rule("mostly_repeated", lambda m: 100 * m.n_repeat_words > 50 * m.n_words, "100 * n_repeat_words > 50 * n_words"))
#: Rules beyond the base; thresholds are ours and catch text drowned in symbols, tables, gaps, copied lines, lists, teasers and figures.
RULES = (
    Rule("symbols", lambda m: 100 * m.n_symbols > 15 * m.n_words, "100 * n_symbols > 15 * n_words"),
    Rule("word_length", lambda m: let(m.word_chars, lambda c: (c > 25 * m.n_words) | (c < 2 * m.n_words)), "word_chars > 25 * n_words OR word_chars < 2 * n_words"),
    Rule("dup_lines", lambda m: 10 * m.n_dup_lines > F.greatest(F.lit(40), m.n_words), "n_dup_lines > 4 AND 10 * n_dup_lines > n_words"),
    Rule("repetition", lambda m: 100 * m.n_repeat_words > 30 * m.n_words, "100 * n_repeat_words > 30 * n_words", covers="mostly_repeated"),
    Rule("bullets", lambda m: share_of_lines(m, lambda x: _any(F.startswith, F.ltrim(x), BULLETS), 9, 10), "10 * len(list_filter(lines, lambda x: " + " OR ".join(f"starts_with(ltrim(x, ' '), '{b}')" for b in BULLETS) + ")) > 9 * len(lines)"),
    Rule("teasers", lambda m: share_of_lines(m, lambda x: _any(F.endswith, F.rtrim(x), DOTS), 3, 10), "10 * len(list_filter(lines, lambda x: " + " OR ".join(f"ends_with(rtrim(x, ' '), '{d}')" for d in DOTS) + ")) > 3 * len(lines)"),
    Rule("figures", lambda m: 10 * F.regexp_count(m.text, F.lit(FIRST_LETTER)) < 7 * m.n_words, f"10 * len(regexp_extract_all(t, '{LETTERED}')) < 7 * n_words"),
)


def _any(test, x: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | test(x, F.lit(mark))
    return found


def order_rules(sample: DataFrame, measures: Callable[[Callable[[Measures], Column]], Column], rules=RULES) -> list[Rule]:
    """Rules by rejected share per second, both measured on the sample; ties keep the given order. A rule's time is that of a pass with it less that of a pass without."""

    def timed(test: Column) -> tuple[float, int]:
        took = []
        for _ in range(2):  # the first compiles
            began = time.perf_counter()
            n = sample.agg(F.sum(test.cast("int"))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), n or 0

    idle = timed(measures(lambda m: m.text.isNull()))[0]
    found = [timed(measures(r.rejects)) for r in rules]
    gain = [n / max(t - idle, 1e-4) for t, n in found]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain[i], i))]


def sample_of(docs: DataFrame, rows: int, seed: int = 11) -> DataFrame:
    """About `rows` rows drawn from all of docs, at most half as many more, in one file."""
    share = min(1.0, 1.2 * rows / max(1, docs.count()))
    return materialize(docs.where(F.rand(seed) < share).limit(rows * 3 // 2).coalesce(1), "sample")


def cascade(rules, m: Measures) -> Column:
    """The first rule that rejects, or null; later rules aren't evaluated then."""
    chain = None
    for r in rules:
        chain = (F if chain is None else chain).when(r.rejects(m), F.lit(r.name))
    return chain if chain is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = 1000) -> DataFrame:
    """Input columns in `row`, the counts, base_failed, rejected_by (rule or null) and kept. The counts are asked for, so every row has them; the rules beyond them run for rows that passed all before."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    slim = with_counts(sample_of(docs.select(docs[text_col].alias("_text")), sample_rows), "_text", "_text")
    ordered = order_rules(materialize(slim, "counted"), lambda test: test(Counted(text)), rules)
    counted = with_counts(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[text_col].alias("_text")), "_text", "row", "_text")
    base = F.expr(BASE)
    judged = counted.select("*", base.alias("base_failed"), F.when(base, F.lit("base")).otherwise(cascade(ordered, Counted(text))).alias("rejected_by")).drop("_text")
    return judged.withColumn("kept", F.col("rejected_by").isNull())


def select_kept(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows of docs that judge keeps, without counts: base and rules are one cascade, and a row that one rejects isn't measured by those after it."""
    on = lambda t, test: let(words(F.coalesce(t, F.lit(""))), lambda w: test(Measures(F.coalesce(t, F.lit("")), w)))
    every = (*[r for r in BASE_RULES if r.name not in {x.covers for x in rules}], *rules)
    sample = sample_of(docs.select(docs[text_col].alias("_text")), sample_rows)
    ordered = order_rules(sample, lambda test: on(F.col("_text"), test), every)
    return docs.where(on(docs[text_col], lambda m: cascade(ordered, m)).isNull())
