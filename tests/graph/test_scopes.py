import time

import pytest

from tessera.operators import scopes

CODE = {
    "python": (
        'import os\n# def no(): pass\nclass A(B):\n    """class C:\n    def d(): """\n    x = "def e():"\n    async def run(self,\n                  y=f(1)):\n        def inner():\n            go(y)\n        return inner()\n\n    def run(self): pass\ndef top():\n\tif x:\n\t\thelp()\n\n# end\ny = top()\n',
        [("class", "A", "A", None, 3, 13), ("method", "run", "A.run", "A", 7, 11), ("method", "inner", "A.inner", "A.run", 9, 10), ("method", "run", "A.run#2", "A", 13, 13), ("function", "top", "top", None, 14, 16)],
        [("f", "A.run", 8), ("go", "A.inner", 10), ("inner", "A.run", 11), ("help", "top", 16)],
    ),
    "java": (
        'package p;\n/* class No { void m() {} } */\n@Deprecated\npublic final class C<T>\n    extends D implements I {\n  private int x = f(1);\n  static { init(); }\n  C(int a) { this.x = a; }\n  @Override\n  public String\n  name(List<String> a) throws E {\n    if (a.size() > 0) { return "}" + go(a); }\n    Runnable r = () -> { work(); };\n    return new Object() { int k() { return 1; } }.toString();\n  }\n  interface In { void one(int a); default int two() { return 2; } }\n  enum E2 { A, B }\n}\nrecord R(int x) {}\n',
        [("class", "C", "C", None, 3, 18), ("method", "C", "C.C", "C", 8, 8), ("method", "name", "C.name", "C", 9, 15), ("interface", "In", "C.In", "C", 16, 16), ("method", "one", "C.In.one", "C.In", 16, 16), ("method", "two", "C.In.two", "C.In", 16, 16), ("type", "E2", "C.E2", "C", 17, 17), ("type", "R", "R", None, 19, 19)],
        [("f", "C", 6), ("init", "C", 7), ("size", "C.name", 12), ("go", "C.name", 12), ("work", "C.name", 13), ("Object", "C.name", 14), ("k", "C.name", 14), ("toString", "C.name", 14)],
    ),
    "c": (
        '#include <x.h>\n#define F(a) {\nstruct s { int a; };\ntypedef struct { int b; } t;\ntypedef unsigned u;\nenum e { A, B };\nint proto(int a);\nint arr[] = { 1, 2 };\nstatic char *\ng(int a)\n{\n  for (int i = 0; i < a; i++) { h("{", \'}\'); }\n  return 0; // }\n}\n',
        [("type", "s", "s", None, 3, 3), ("type", "t", "t", None, 4, 4), ("type", "u", "u", None, 5, 5), ("type", "e", "e", None, 6, 6), ("function", "g", "g", None, 9, 14)],
        [("h", "g", 12)],
    ),
    "cpp": (
        'namespace n {\nclass K : public B {\n public:\n  K(int a) : x(a) {}\n  int get() const { return R"(})" ? go() : 0; }\n};\nvoid K::run() { get(); }\nint free_one(int a) { return a; }\n}\nenum class E { A };\n',
        [("class", "K", "n::K", None, 2, 6), ("method", "K", "n::K::K", "n::K", 3, 4), ("method", "get", "n::K::get", "n::K", 5, 5), ("function", "run", "n::run", None, 7, 7), ("function", "free_one", "n::free_one", None, 8, 8), ("type", "E", "E", None, 10, 10)],
        [("x", "n::K", 4), ("go", "n::K::get", 5), ("get", "n::run", 7)],
    ),
    "go": (
        'package m\n\nimport "fmt"\n\nvar x = 1\n\ntype S struct {\n\ta int\n}\ntype I interface { M() }\ntype N int\n\n// func no() {}\nfunc (s *S) Do(a int) int {\n\tf := func() { work() }\n\ts.m[`}`](a)\n\treturn go1(a)\n}\n\nfunc Top() { fmt.Println("}") }\n',
        [("type", "S", "S", None, 7, 9), ("type", "I", "I", None, 10, 10), ("type", "N", "N", None, 11, 11), ("method", "Do", "Do", None, 14, 18), ("function", "Top", "Top", None, 20, 20)],
        [("M", "I", 10), ("work", "Do", 15), ("go1", "Do", 17), ("Println", "Top", 20)],
    ),
    "rust": (
        "use a::b;\npub struct P(u8);\nstruct Q<'a> {\n  x: &'a str,\n}\nenum E { A, B }\npub trait T { fn sig(&self); fn def(&self) { one(); } }\nimpl<'a> T for Q<'a> {\n  fn sig(&self) { let c = '}'; two(r#\"}\"#); }\n}\nfn main() { /* } */ P(1); }\n",
        [("type", "P", "P", None, 2, 2), ("type", "Q", "Q", None, 3, 5), ("type", "E", "E", None, 6, 6), ("interface", "T", "T", None, 7, 7), ("method", "def", "T.def", "T", 7, 7), ("method", "sig", "Q.sig", None, 9, 9), ("function", "main", "main", None, 11, 11)],
        [("sig", "T", 7), ("one", "T.def", 7), ("two", "Q.sig", 9), ("P", "main", 11)],
    ),
}


@pytest.mark.parametrize("language", CODE)
def test_declarations_and_calls(language):
    text, declared, called = CODE[language]
    rows = scopes.parse(language, text)
    assert [(r["kind"], r["name"], r["qualified"], r["holder"], r["first"], r["last"]) for r in rows if r["what"] == "declaration"] == declared
    assert [(r["name"], r["holder"], r["first"]) for r in rows if r["what"] == "call"] == called


def test_odd_texts_end_in_time():
    began = time.time()
    for language in scopes.LANGUAGES:
        for text in ("{" * 100_000, "}" * 100_000, "(" * 50_000, '"' * 100_001, "/*" * 50_000, "a " * 100_000, "\n" * 100_000, "class A {" * 500, "x(" * 20_000, "'" * 100_001, "#\\\n" * 30_000, "r#" * 30_000, "\\" * 100_000):
            scopes.parse(language, text)
    assert time.time() - began < 60


def test_frames(spark):
    files = [(f"f.{k}", k, CODE[k][0]) for k in CODE] + [("n", "java", None), ("e", "java", ""), ("o", "cobol", "class A {}"), ("d", "python", "def a():\n  b()\n  c()\n  c2()\ndef c(): pass\nclass X:\n  def c2(self): pass\n  def c2(self): pass\n")]
    rows = scopes.read_scopes(spark.createDataFrame(files, "path string, language string, text string"))
    assert rows.where("what = 'declaration'").count() == sum(len(x[1]) for x in CODE.values()) + 5
    got = {(r.caller, r.name): (r.target, r.reason) for r in scopes.local_calls(rows).where("path = 'd'").collect()}
    assert got == {("a", "b"): (None, "no-local-structural-target"), ("a", "c"): ("c", None), ("a", "c2"): (None, "ambiguous-local-structural-target")}


def test_words_before_parentheses_cost_their_length():
    text = "class A {" + ("a" * 199 + "-(1);\n") * 20_000 + "}"
    began = time.time()
    scopes.parse("java", text)
    assert time.time() - began < 3
    for before, name in (("x", "x"), ("  foo  ", "foo"), ("9a", "a"), ("9", None), ("a.b$1 \n", "b$1"), ("é", None), ("aé", "aé"), ("", None), ("$", "$"), ("1_x9", "_x9")):
        assert scopes._named_call(before, 0, len(before)) == name
