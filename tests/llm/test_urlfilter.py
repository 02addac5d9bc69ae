import random

import pytest

from tessera.llm import urlfilter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("xample.com", "/", "block"), ("a.net", "/e", "allow"), ("org", "", "block")]


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len((h + p).encode()), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, default)


@pytest.mark.parametrize("part", [1 << 20, 1])
def test_against_brute_force(spark, part):
    r = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "a.www.EXAMPLE.com", "xample.com", "fexample.com", "b.a.net", "net", "x.org", "", "com.", "é.net"]
    urls = [f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/es/x', '/fr/', '/e', '/ä'])}{r.choice(['', '?a=/en/', '#/es/', '/x://y'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http://user@example.com/en/", "http://" + "sub." * 300 + "example.com/en/" + "x" * 5000, "http://a.net\n/es/"]
    df = spark.createDataFrame([(i, u, "v", "r") for i, u in enumerate(urls)], "page_id long, url string, verdict string, rule string")
    got = urlfilter.filter_urls(df, RULES, part_bytes=part).collect()
    assert {x.row.page_id: (x.host, x.path, x.rule, x.verdict) for x in got} == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_empty(spark):
    df = spark.createDataFrame([(1, "http://x.net/es/")], "page_id long, url string")
    assert [(x.rule, x.verdict) for x in urlfilter.filter_urls(df, [], default="block").collect()] == [(None, "block")]
    assert urlfilter.filter_urls(df.limit(0), RULES).count() == 0


def test_collision_is_confirmed(monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda k: len(k) % 3)
    array = urlfilter.DigestArray([(f"h{i}", "/", "block") for i in range(50)])
    assert list(array.find([b"h7/", b"h77/", b"h49/"])) == [array.find([b"h7/"])[0], -1, array.find([b"h49/"])[0]]
    ends, blob = array.open()[1], array.open()[2]
    j = array.find([b"h7/"])[0]
    assert blob[ends[j - 1] if j else 0 : ends[j]].tobytes() == b"h7/"


def test_very_long_host_and_many_parts(spark):
    rules = [(f"h{i}.com", "/", "block") for i in range(60)] + [("x" * 5000 + ".org", "/p" * 3000, "block")]
    urls = [(1, "http://" + "a." * 30_000 + "h7.com/x"), (2, "http://" + "x" * 5000 + ".org" + "/p" * 3000), (3, "http://h9.comx/"), (4, "http://.h3.com/"), (5, "http://h59.com/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {x.row.page_id: x.rule for x in urlfilter.filter_urls(pages, rules, part_bytes=300, parts_a_pass=2).collect()}
    assert got == {1: "h7.com/", 2: "x" * 5000 + ".org" + "/p" * 3000, 3: None, 4: "h3.com/", 5: "h59.com/"}
