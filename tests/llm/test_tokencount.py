import random

import pytest

from tessera.llm import tokencount

SMALL = [("▁", -3.0), ("▁a", -2.0), ("a", -2.5), ("b", -2.5), ("ab", -4.0), ("▁ab", -4.5), ("ba", -4.5), ("aba", -6.5), ("▁▁", -1.0), ("bb", -5.0), ("c", -2.0), ("é", -3.0)]


def brute(vocabulary, text, byte_fallback):
    """All segmentations; among the best scores the one the tie rule takes."""
    table = dict(vocabulary)
    unknown = min(table.values()) - tokencount.UNKNOWN_PENALTY
    best = {0: (0.0, 0, False)}
    for end in range(1, len(text) + 1):
        found = None
        for start in range(end):
            piece = text[start:end]
            if piece in table:
                s, run, n = best[start][0] + table[piece], False, best[start][1] + 1
            elif end - start == 1:
                s, run = best[start][0] + unknown, True
                n = best[start][1] + (len(piece.encode()) if byte_fallback else int(not best[start][2]))
            else:
                continue
            if found is None or s > found[0]:
                found = (s, n, run)
        best[end] = found
    return best[len(text)][1], best[len(text)][0]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_against_brute_force(byte_fallback):
    r = random.Random(3)
    counter = tokencount.Counter(SMALL, byte_fallback, 5)
    for _ in range(600):
        w = "".join(r.choice("aabbcéxß▁") for _ in range(r.randint(0, 12)))
        assert counter.solve(w) == pytest.approx(brute(SMALL, w, byte_fallback))


def test_against_public_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    vocabulary = tokencount.load_vocabulary(str(public.path("piece_bpe_32k.model")))
    # one more piece stands for unknown characters; byte pieces make the fallback possible
    pieces = [("<unk>", 0.0), *[(f"<0x{i:02X}>", -1e12) for i in range(256)], *vocabulary]
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, 0, True))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = tokencount.Counter(vocabulary, True, 1000)
    r = random.Random(1)
    words = ["the", "thereon", "enölichch", "ßchau", "hello,", "naïve", "123", "foo_bar", "執梦", "🙂x", "Ünter", "queéé", "!!!", "aaaaaaaaaa", "\u00a0x"]
    for _ in range(300):
        text = " ".join(r.choice(words) + r.choice(["", "", "ing", "."]) for _ in range(r.randint(1, 12)))
        assert counter.text(text)[1] == len(t.encode(text, add_special_tokens=False).ids), text


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, " \n", 7), (4, "ab  ab\tc", 8), (4, "ab  ab\tc", 8), (None, "a▁ b", 9)], "doc_id long, text string, n_tokens long")
    got = tokencount.count_tokens(df, SMALL).select("row.doc_id", "n_words", "n_tokens", "row.n_tokens").collect()
    c = tokencount.Counter(SMALL, True, 10)
    want = [(1, 0, 0), (2, 0, 0), (3, 0, 0), *[(4, 3, 2 * c.solve("▁ab")[0] + c.solve("▁c")[0])] * 2, (None, 2, c.solve("▁a▁▁b")[0])]
    assert sorted([tuple(x)[:3] for x in got], key=repr) == sorted(want, key=repr)
    assert tokencount.count_tokens(df.limit(0), SMALL).count() == 0
    assert tokencount.count_tokens(df, []).count() == 6


def test_long_text():
    c = tokencount.Counter(SMALL, True, 10)
    assert c.text("ab " * 200_000)[0] == 200_000
    assert c.solve("c" * 100_000)[0] == 100_000


def test_blanks_count_as_in_the_tokenizer(spark, tmp_path):
    from tessera.llm import queries

    sentencepiece = pytest.importorskip("sentencepiece")
    path = str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = tokencount.Counter(tokencount.load_vocabulary(path), True, 1000, tokencount.keeps_blanks(path))
    r = random.Random(4)
    blank = ["", " ", "\n", " \n", "\t\t", "  \n\n\t ", *["".join(r.choice([" ", "\n", "\t"]) for _ in range(r.randint(1, 30))) for _ in range(50)]]
    for t in blank:
        assert counter.text(t)[1] == len(model.encode(t)), repr(t)
    mixed = ["one line\nanother line\n\nlast", "a\r\nb", *["".join(r.choice(["the", "last", "enölich", "(執▁x", " ", "  ", "\n", "\t", "\r\n", "     "]) for _ in range(r.randint(1, 20))) for _ in range(200)]]
    for t in mixed:
        assert counter.text(t)[1:] == counter.solve(model.normalize(t)), repr(t)
    spark.createDataFrame([(k, t) for k, t in enumerate([*blank, *mixed])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.n_tokens for x in queries.op6_token_counts(spark, str(tmp_path)).collect()}
    assert got == {k: counter.solve(model.normalize(t))[0] for k, t in enumerate([*blank, *mixed])}


def test_blanks_against_public_unigram():
    tokenizers = pytest.importorskip("tokenizers")
    path = str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    vocabulary = tokencount.load_vocabulary(path)
    t = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *[(f"<0x{i:02X}>", -1e12) for i in range(256)], *vocabulary], 0, True))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="never", split=False)
    counter = tokencount.Counter(vocabulary, True, 1000, True)
    r = random.Random(6)
    for _ in range(200):
        text = "".join(r.choice(["the", "last", "enölich", "執", "x.", " ", "  ", "\n", "\t", "\n\n"]) for _ in range(r.randint(1, 20)))
        assert counter.text(text)[1] == len(t.encode(" " + text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_kept_blanks_against_the_whole_text(byte_fallback):
    r = random.Random(5)
    for vocabulary in (SMALL, SMALL[1:], [*SMALL, ("a▁b", -3.0)], [*SMALL, ("b\r", -3.0), ("\v", -2.0)]):
        counter = tokencount.Counter(vocabulary, byte_fallback, 5, True)
        for _ in range(300):
            t = "".join(r.choice("aabcx▁   \n\n\t\r\v") for _ in range(r.randint(0, 14)))
            want = brute(vocabulary, "▁" + t.replace(" ", "▁"), byte_fallback) if t else (0, 0.0)
            assert counter.text(t) == (len(t.split()), *want), repr(t)
