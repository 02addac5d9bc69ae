"""Declarations with scopes and calls of six languages, by one pass over a text with a stack.

Comments, strings and preprocessor lines are blanked first, at equal length, so nothing in them declares or calls
and lines stay. Brace languages are then cut into headers (what stands before a brace or a semicolon outside
parentheses, over as many lines as it takes); a header names a declaration or opens a plain block. Python goes by
logical lines and indentation. Every row has its first and last line and the qualified name of what holds it.

This is no compiler: macros, templates' bodies and generated code are read as they stand. A block that isn't
closed ends with the text. Null texts and other languages give no rows. A file is one row's work: a very long one
is read in time proportional to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STRING, _LINE, _BLOCK = r'"(?:\\.|[^"\\\n])*+"?', r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_CHAR = r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"
_PRE = r"^[ \t]*#(?:\\\n|[^\n])*"
#: What is blanked, by language.
MASKS = {
    "python": re.compile(r'#[^\n]*|"""(?:\\.|[^\\])*?(?:"""|\Z)|' + r"'''(?:\\.|[^\\])*?(?:'''|\Z)|" + _STRING + r"|'(?:\\.|[^'\\\n])*+'?", re.S),
    "c": re.compile("|".join((_LINE, _BLOCK, _STRING, _CHAR, _PRE)), re.S | re.M),
    "java": re.compile("|".join((_LINE, _BLOCK, r'"""(?:\\.|[^\\])*?(?:"""|\Z)', _STRING, _CHAR)), re.S),
    "go": re.compile("|".join((_LINE, _BLOCK, r"`[^`]*`?", _STRING, _CHAR)), re.S),
    "rust": re.compile("|".join((_LINE, _BLOCK, r'\br(#*)".*?(?:"\1|\Z)', _STRING, _CHAR)), re.S),
}
MASKS["cpp"] = re.compile("|".join((r'\bR"([^\s()\\]{0,16})\(.*?(?:\)\1"|\Z)', MASKS["c"].pattern)), re.S | re.M)
LANGUAGES = tuple(MASKS)

_WORD = r"[A-Za-z_$][\w$]*"
#: Words that stand before a parenthesis or in a header without declaring or calling.
CONTROL = frozenset("if else for while do switch case catch try finally synchronized return throw new unsafe sizeof alignof decltype static_assert elif and or not in is lambda assert yield await del raise except fn def class".split())
OWN_CONTROL = {"go": frozenset({"func", "go", "defer", "select"}), "rust": frozenset({"match", "loop"}), "python": frozenset({"with", "match"})}
#: A word and the blanks behind it, turned round: read from a parenthesis backwards.
_CALLED_BEFORE = re.compile(r"\s*([\w$]*[A-Za-z_$])")


def _named_call(code: str, start: int, end: int) -> str | None:
    """The word that ends, but for blanks, at `end`; from its first letter on, if it begins with a digit."""
    m = _CALLED_BEFORE.match(code[start:end][::-1])
    return m[1][::-1] if m else None


_TYPES = {
    "java": (re.compile(r"(?<![.\w])(class|interface|enum|record)\s+(\w+)"), {"class": "class", "interface": "interface", "enum": "type", "record": "type"}),
    "c": (re.compile(r"\b(struct|union|enum)\s+(\w+)\s*$"), {"struct": "type", "union": "type", "enum": "type"}),
    "cpp": (re.compile(r"\b(class|struct|union|enum(?:\s+class)?|namespace)\s+(\w+(?:::\w+)*)\s*(?:final\s*)?(?::(?!:)[^{]*)?$"), {"class": "class", "namespace": "namespace"}),
    "rust": (re.compile(r"\b(struct|enum|trait)\s+(\w+)"), {"struct": "type", "enum": "type", "trait": "interface"}),
    "go": (re.compile(r"^\s*(type)\s+(\w+)", re.M), {"type": "type"}),
}
_C_FUNCTION = re.compile(r"(?:^|[\s*&>])((?:\w+::)*~?[A-Za-z_]\w*)\s*\(")
_JAVA_METHOD = re.compile(rf"(?:^|[\s>\]])({_WORD})\s*\((?:[^()]|\([^()]*\))*\)\s*(?:throws\s[\w\s,.]+)?$")
_GO_FUNCTION = re.compile(r"(?:^|\n)\s*func\s+(\([^)]*\)\s*)?(\w+)\s*[\[(]")
_RUST_FUNCTION, _RUST_IMPL = re.compile(r"\bfn\s+(\w+)"), re.compile(r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>(?=\s))?\s*(?:[^{]*?\sfor\s+)?&?\s*(?:\w+::)*(\w+)")
OPENERS = ("class", "interface", "type", "namespace", "impl")


def blanked(language: str, text: str) -> str:
    return MASKS[language].sub(_blank, text)


def _blank(m: re.Match) -> str:
    found = m.group()
    return "\n".join([" " * len(line) for line in found.split("\n")]) if "\n" in found else " " * len(found)


class Found:
    """Declarations and calls of a file, with a stack of what is open. A scope that isn't declared itself (namespace, impl) names its members all the same."""

    def __init__(self, language: str):
        self.language, self.rows, self.calls, self.stack, self.names = language, [], [], [], {}

    def open(self, kind: str, name: str, line: int, scope: bool = True) -> None:
        holders = [s for s in self.stack if s[0] is not None]
        container = [n for s in holders for n in ([s[2]] if s[1] in OPENERS else [])]
        if kind == "function" and container and not (self.language == "cpp" and not any(s[3] is not None for s in holders)):
            kind = "method"
        row = None
        if kind not in ("namespace", "impl"):
            joint = "::" if self.language == "cpp" else "."
            plain = joint.join([*container, name])
            n = self.names[kind, plain] = self.names.get((kind, plain), 0) + 1
            row = {"what": "declaration", "kind": kind, "name": name, "qualified": plain if n == 1 else f"{plain}#{n}", "holder": self.holder(), "first": line, "last": line}
            self.rows.append(row)
        if scope:
            self.stack.append((kind, kind, name, row))

    def block(self) -> None:
        self.stack.append((None, None, None, None))

    def close(self, line: int) -> None:
        if self.stack and (row := self.stack.pop()[3]):
            row["last"] = line

    def holder(self) -> str | None:
        return next((s[3]["qualified"] for s in reversed(self.stack) if s[3]), None)

    def inside(self) -> str | None:
        """The kind of the innermost declared scope or block; None for a plain block or the file."""
        return self.stack[-1][0] if self.stack else None

    def call(self, name: str, line: int) -> None:
        if name not in CONTROL and name not in OWN_CONTROL.get(self.language, ()) and (holder := self.holder()):
            self.calls.append({"what": "call", "kind": None, "name": name, "qualified": None, "holder": holder, "first": line, "last": line})


def header(found: Found, text: str, body: bool) -> tuple[str, str] | None:
    """(kind, name) of what a header declares; `body`: a brace follows, else a semicolon or line end."""
    language = found.language
    if language == "java":
        text = re.sub(r"@(?!interface\b)[\w.]+(?:\s*\([^()]*\))?", " ", text)
    if language == "rust":
        if (m := _RUST_FUNCTION.search(text)) and body:
            return "function", m[1]
        if body and (m := _RUST_IMPL.search(text)):
            return "impl", m[1]
    if language == "go" and (m := _GO_FUNCTION.search(text)):
        return ("method" if m[1] else "function", m[2]) if body else None
    pattern, kinds = _TYPES[language]
    m = pattern.search(text)
    if m and (body or language in ("rust", "go")) and not (language in ("c", "cpp") and re.search(r"[=(]", text[: m.start()])):
        return kinds.get(m[1].split()[0], "type"), m[2].split("::")[-1]
    if language == "java" and found.inside() in ("class", "interface", "type") and "=" not in text and not re.search(r"\b(?:new|return)\s|->", text):
        m = _JAVA_METHOD.search(text)
        if m and m[1] not in CONTROL and (body or text[: m.start(1)].strip()):
            return "method", m[1]
    if language in ("c", "cpp") and body and found.inside() not in ("function", "method") and not any(s[0] is None or s[0] in ("function", "method") for s in found.stack):
        m = _C_FUNCTION.search(text)
        before = text[: m.start(1)] if m else ""
        if m and "=" not in before and m[1].split("::")[-1] not in CONTROL and (before.strip() or language == "cpp" and ("::" in m[1] or found.inside())):
            return "function", m[1].split("::")[-1]
    return None


def braces(language: str, text: str) -> Found:
    code, found = blanked(language, text), Found(language)
    line, start, first, depth, kept, calls, named, tail = 1, 0, None, 0, [], [], None, ""

    def decide(upto: int, body: bool) -> bool:
        """Whether the header that ends here declares something."""
        nonlocal calls
        said = header(found, code[start:upto], body) if depth == 0 and code[start:upto].strip() else None
        own, calls = calls, []
        for name, at in own:
            if not (said and name == said[1]):
                found.call(name, at)
        if said:
            found.open(*said, first or line, scope=body)
        return bool(said)

    for m in re.finditer(r"[(){}\[\];\n]|[^\s(){}\[\];]+", code):
        sign = m.group()
        if sign == "\n":
            if language == "go" and depth == 0 and first is not None and (tail.isalnum() or tail in "_)]}"):
                decide(m.start(), False)
                start, first = m.end(), None
            line += 1
            continue
        elif sign in "([":
            if sign == "(" and (x := _named_call(code, max(start, m.start() - 200), m.start())):
                calls.append((x, line))
            depth += 1
        elif sign in ")]":
            depth = max(0, depth - 1)
        elif sign == "{":
            typedef = re.match(r"\s*typedef\b", code[start : m.start()]) if language in ("c", "cpp") and depth == 0 else None
            at = first or line
            if not decide(m.start(), True):
                found.block()
            kept.append((depth, at if typedef else None))
            start, first, depth = m.end(), None, 0
        elif sign == "}":
            decide(m.start(), False)
            if kept:
                depth, named = kept.pop()
                found.close(line)
            start, first = m.end(), None
        elif sign == ";":
            if depth == 0:
                text_here = code[start : m.start()]
                alias = re.search(r"(\w+)\s*(?:\[[^\]]*\])?\s*$", text_here) if named or language in ("c", "cpp") and re.match(r"\s*typedef\b", text_here) else None
                pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)", text_here) if alias is None and re.match(r"\s*typedef\b", text_here) and language in ("c", "cpp") else None
                if x := alias or pointer:
                    calls = []
                    found.open("type", x[1], named or first or line, scope=False)
                    found.rows[-1]["last"] = line
                else:
                    decide(m.start(), False)
                start, first, named = m.end(), None, None
        elif first is None:
            first = line
        tail = sign[-1]
    while found.stack:
        found.close(line)
    return found


_DEF = re.compile(r"\s*(?:async\s+)?(def|class)\s+(\w+)")
_ANY_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")


def indented(text: str) -> Found:
    found, lines, levels, last = Found("python"), blanked("python", text).split("\n"), [], 0
    n = 0
    while n < len(lines):
        first, logical = n + 1, [lines[n]]
        depth = sum(map(lines[n].count, "([{")) - sum(map(lines[n].count, ")]}"))
        while (depth > 0 or logical[-1].rstrip().endswith("\\")) and n + 1 < len(lines):
            n += 1
            logical.append(lines[n])
            depth += sum(map(lines[n].count, "([{")) - sum(map(lines[n].count, ")]}"))
        n += 1
        if not logical[0].strip():
            continue
        indent = len(logical[0].expandtabs(8)) - len(logical[0].expandtabs(8).lstrip())
        while levels and indent <= levels[-1]:
            levels.pop()
            found.close(last)
        last, m = n, _DEF.match(logical[0])
        if m:
            found.open("function" if m[1] == "def" else "class", m[2], first)
            levels.append(indent)
        for k, part in enumerate(logical):
            for call in _ANY_CALL.finditer(part, m.end() if m and k == 0 else 0):
                found.call(call[1], first + k)
    while levels:
        levels.pop()
        found.close(last)
    return found


def parse(language: str, text: str) -> list[dict]:
    found = indented(text) if language == "python" else braces(language, text)
    return found.rows + found.calls


SCHEMA = "path string, what string, kind string, name string, qualified string, holder string, first long, last long"


def read_scopes(files: DataFrame) -> DataFrame:
    """path, language, text -> declarations and calls: path, what, kind, name, qualified, holder, first and last line."""
    kind = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "text")), strict=True):
                if rows := parse(language, text) if text else []:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[f.name] for r in rows], f.type) for f in kind if f.name != "path")], schema=kind)

    return files.where(F.col("language").isin(*LANGUAGES)).select("path", "language", "text").mapInArrow(run, SCHEMA)


def local_calls(rows: DataFrame) -> DataFrame:
    """path, caller, name, line, target, reason: calls with the one declaration of their name in the file, else no target and why."""
    known = rows.where("what = 'declaration'").groupBy("path", "name").agg(F.count("*").alias("n"), F.min("qualified").alias("only"))
    calls = rows.where("what = 'call'").select("path", F.col("holder").alias("caller"), "name", F.col("first").alias("line"))
    reason = F.when(F.col("n").isNull(), "no-local-structural-target").when(F.col("n") > 1, "ambiguous-local-structural-target")
    return calls.join(known, ["path", "name"], "left").select("path", "caller", "name", "line", F.when(F.col("n") == 1, F.col("only")).alias("target"), reason.alias("reason"))
