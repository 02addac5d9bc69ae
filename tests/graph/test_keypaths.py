import json
import random
import time
import tomllib

from tessera.operators import keypaths as K


def leaves(x, path=()):
    if isinstance(x, dict):
        return [y for k, v in x.items() for y in leaves(v, (*path, k))]
    if isinstance(x, list):
        return [y for k, v in enumerate(x) for y in leaves(v, (*path, k))]
    return [(K.joined(list(path)), x if isinstance(x, str) else json.dumps(x))]


def made(r, depth):
    if depth == 0 or r.random() < 0.3:
        return r.choice(["a", "", 'q"\\\n{', "x: y # z", 7, -1.5, True, None])
    if r.random() < 0.5:
        return [made(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {r.choice(["k", "a.b", "é", "", 'q"']) + str(i): made(r, depth - 1) for i in range(r.randint(0, 4))}


def test_json_against_parser():
    r = random.Random(1)
    for _ in range(300):
        x = made(r, 4)
        for indent in (None, 2):
            assert [(k, v) for k, v, _ in K.of_json(json.dumps(x, indent=indent, ensure_ascii=r.random() < 0.5))] == leaves(x)
    assert list(K.of_json('{\n "a": [1,\n  {"b": "x"}],\n "c": null\n}\n')) == [("a.0", "1", 2), ("a.1.b", "x", 3), ("c", "null", 4)]
    assert list(K.of_json('{"a": 1, b: 2}')) == [("a", "1", 1), (None, "malformed at 9", 1)] and list(K.of_json('{"a": [1')) == [("a.0", "1", 1), (None, "not closed", 1)]
    assert list(K.of_json("")) == [] and list(K.of_json(" \n ")) == []


def test_yaml():
    text = """# head
a: 1  # one
b:
  c: 'it''s # no'
  "d.e": "x\\ty"
  list:
  - p
  - q: 1
    r: 2
  -
    s: 3
  f: [1, 2]
text: |
  line: no
    more

url: http://x/y
- stray
---
next: {a: b}
nested:
    - - 1
      - 2
    - x: y
empty:
last: -5
"""
    assert list(K.of_yaml(text)) == [
        ("a", "1", 2), ("b.c", "it's # no", 4), ('b."d.e"', "x\ty", 5), ("b.list.0", "p", 7), ("b.list.1.q", "1", 8), ("b.list.1.r", "2", 9), ("b.list.2.s", "3", 11), ("b.f", "[1, 2]", 12),
        ("text", "line: no\nmore", 13), ("url", "http://x/y", 17), ("url.0", "stray", 18), ("next", "{a: b}", 20), ("nested.0.0", "1", 22), ("nested.0.1", "2", 23), ("nested.1.x", "y", 24), ("last", "-5", 26),
    ]


def test_toml_against_parser():
    text = """top = "a # b" # c
[t."x.y"]
k.l = 'lit\\n'
n = 5
arr = [ 1, # no
  "]" ]
m = \"\"\"
one
two\"\"\"
[[items]]
p = "1"
[items.sub]
q = "2"
[[items]]
p = "3"
"""
    got = list(K.of_toml(text))
    assert [(k, v) for k, v, _ in got if not k.endswith("arr") and not k.endswith("n")] == [(k, v) for k, v in leaves(tomllib.loads(text.replace('"]"', '"z"'))) if ".arr" not in k and not k.endswith(".n")]
    assert [x[2] for x in got] == [1, 3, 4, 5, 7, 11, 13, 15] and ('t."x.y".n', "5", 4) in got


def test_odd_texts_end_in_time():
    began = time.time()
    for read in K.READERS.values():
        for text in ("[" * 50_000, "{" * 50_000, '"' * 50_001, "a:" * 50_000, "- " * 300, " " * 200_000, "\n" * 100_000, ", " * 50_000, "[" * 20_000 + "\n" * 1000, "k = [\n" * 5_000, "#" * 100_000, "x = '''\n" * 5_000, "\\" * 50_000, "a." * 30_000 + "b = 1"):
            list(read(text))
    assert time.time() - began < 40


def test_frames(spark):
    files = [("d/a.json", "json", '{"extends": "../base.json",\n "other": "../base.json", "files": ["x.ts", "y"], "schema": "http://a/b.json"}'), ("d/b.yaml", "yaml", "include:\n  path: ./c.yaml\n"), ("n", "toml", None), ("o", "xml", "<a/>")]
    keys = K.key_paths(spark.createDataFrame(files, "path string, language string, text string"))
    refs = K.config_references(keys, spark.createDataFrame([("base.json",), ("d/a.json",)], "path string"))
    assert sorted(map(tuple, refs.collect())) == [("d/a.json", "extends", 1, "../base.json", "base.json"), ("d/b.yaml", "include.path", 2, "./c.yaml", None)]
