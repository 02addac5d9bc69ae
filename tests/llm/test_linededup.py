import random
import re

import pytest

from tessera.llm import linededup, prefilter

SCHEMA = "doc_id long, text string, kept string, removed string"


def cut(text, unit):
    """Units of a text, by another way than the operator's patterns."""
    out, own = [], ""
    for i, c in enumerate(text):
        own += c
        after = text[i + 1 : i + 2]
        if unit == "line":
            end = c == "\n"
        elif unit == "paragraph":
            end = c == "\n" and after != "\n" and (own[-2:-1] == "\n" or own.strip("\n") == "")
        else:
            end = c == "\n" or (c in ".!?。！？" and after not in tuple(".!?。！？\n"))
        if end:
            out.append(own)
            own = ""
    return out + [own] * (own != "")


def brute(rows, unit, least=1, run=0):
    words = lambda u: re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in u))
    first, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k, u in enumerate(cut(text or "", unit)):
            if len(words(u)) >= least:
                first.setdefault(tuple(words(u)), (i, text, k))
    for i, text in rows:
        own = cut(text or "", unit)
        again = [len(words(u)) >= least and first[tuple(words(u))] != (i, text, k) for k, u in enumerate(own)]
        gone, at = [], 0
        spans = []
        for u in own:
            spans.append((at, at + len(u)))
            at += len(u)
        held = []
        for k in range(len(own) + 1):
            if k < len(own) and (again[k] or not words(own[k])):
                held += [k] * again[k]
                continue
            if sum(len(words(own[j])) for j in held) >= run:
                gone += held
            held = []
        out.append((i, len(own), [(k, *spans[k]) for k in gone], None if text is None else "".join(u for k, u in enumerate(own) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("unit", "least", "run"), [("line", 1, 0), ("line", 3, 0), ("paragraph", 1, 0), ("sentence", 1, 0), ("sentence", 1, 12)])
def test_against_brute_force(spark, unit, least, run):
    r = random.Random(2)
    pool = [" ".join(r.choice(["a", "B", "ç", "dd"]) for _ in range(r.randint(0, 9))) for _ in range(40)]
    rows = [(i, "".join(r.choice(pool) + r.choice(["", " ", "\t", "\r", ".", "?!", ". "]) + r.choice(["\n", "\n\n", "", " "]) for _ in range(r.randint(0, 9)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, pool[3] + "\n" + pool[5]), (103, rows[4][1]), (103, rows[4][1]), (104, "w " * 50_000), (105, "二百五十。\n二百五十！x")]
    df = spark.createDataFrame([(*x, "k", "r") for x in rows], SCHEMA)
    got = linededup.dedup_lines(df, unit=unit, min_words=least, min_run=run).collect()
    assert sorted([(x.id, x.n_units, [tuple(y) for y in x.removed], x.kept) for x in got], key=repr) == brute(rows, unit, least, run)
    assert linededup.dedup_lines(df.limit(0), unit=unit).count() == 0


def test_passages_are_the_runs_of_sentences_beside_lines(spark):
    r = random.Random(4)
    pool = [" ".join(r.choice(["a", "B", "ç", "dd", "e"]) for _ in range(r.randint(0, 7))) for _ in range(60)]
    rows = [(i, "".join(r.choice(pool) + r.choice([".", "?!", ". ", ""]) + r.choice(["\n", "", " "]) for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n" * 2000), (103, "Long one. " * 20_000), (104, "x" * 300_000)]
    df = spark.createDataFrame([(*x, "k", "r") for x in rows], SCHEMA)
    got = sorted(linededup.dedup_lines(df, passage_words=12).collect(), key=repr)
    assert sorted([(x.id, x.n_units, [tuple(y) for y in x.removed], x.kept) for x in got], key=repr) == brute(rows, "line")
    texts, want = dict(rows), {}
    for i, n, gone, _ in brute(rows, "sentence", 1, 12):
        numbers, text = {k for k, _, _ in gone}, texts[i] or ""
        runs, held, at = [], [], 0
        for k, u in enumerate(cut(text, "sentence")):
            if k in numbers:
                held += [at, at + len(u)]
            elif u.split():
                runs, held = runs + [(held[0], held[-1])] if held else runs, []
            at += len(u)
        want[i] = runs + [(held[0], held[-1])] if held else runs
    assert {x.id: [tuple(y) for y in x.passages] for x in got} == want
    assert sum(map(len, want.values())) > 5
    with pytest.raises(ValueError, match="min_run"):
        linededup.dedup_lines(df, unit="sentence", passage_words=12)


def test_a_passage_inside_a_line_goes_and_a_common_line_stays(spark):
    passage = "One of these was long enough to be told. The next one follows it at once! And a third sentence ends it all."
    rows = [(1, f"First text here {passage} Own end.\nAll rights reserved."), (2, f"Second {passage} Other end.\nAll rights reserved.")]
    got = {x.id: x.kept for x in linededup.dedup_lines(spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA), unit="sentence", min_run=10).collect()}
    assert got[1] == rows[0][1]
    assert got[2] == "Second One of these was long enough to be told. Other end.\nAll rights reserved."


def test_prefilter_takes_any_column_names(spark):
    names = ["_b", "_p", "_map", "_byte", "_maybe", "b", "p", "map", "row", "a.b"]
    df = spark.createDataFrame([(i, *["x"] * len(names)) for i in range(50)] + [(None, *["y"] * len(names))], ["k", *names])
    some = df.where("k % 5 = 0").select("k")
    maybe, rest = prefilter.split(df, some, "k")
    assert maybe.columns == rest.columns == df.columns
    assert maybe.count() + rest.count() == 51 and {x.k for x in maybe.collect()} >= set(range(0, 50, 5))
    assert sorted((x.k for x in prefilter.without(df, some, "k").collect()), key=repr) == sorted([*(i for i in range(50) if i % 5), None], key=repr)
