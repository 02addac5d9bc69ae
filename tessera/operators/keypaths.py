"""Key paths of JSON, YAML and TOML texts with the lines they stand in, and the references their values make.

JSON is read by a stack of open brackets, YAML by a stack of indents, TOML by its table headers. Sequence items
are numbered from 0. A path's parts are joined by dots; a part with a dot or quote in it stands in quotes. Only
scalars have rows. Values are as written, without quotes; escapes of quoted JSON and TOML strings are resolved.

JSON that breaks off or is malformed keeps the rows before that place and has a last row with key null and a
reason. YAML anchors, tags and flow collections that go over lines are read as text; block scalars are one value.
Null and empty texts have no rows.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Row = tuple[str | None, str | None, int]
_JSON = re.compile(r'[\s,]*(?:("(?:[^"\\\n]|\\.)*")|([{}\[\]:])|(-?\d[\d.eE+-]*|true|false|null))')
_BETWEEN = re.compile(r"[\s,]*")
#: A key that speaks of a path, and a value that looks like one. The formats of explicit references.
PATH_KEY, PATH_VALUE = r"(?i)(?:path|file|extends|include|schema|config|workspace|source)", r"/|\.[A-Za-z0-9]+$"


def joined(parts: list) -> str:
    return ".".join(json.dumps(p, ensure_ascii=False) if isinstance(p, str) and (not p or re.search(r'[."\s]', p)) else str(p) for p in parts)


def of_json(text: str) -> Iterator[Row]:
    stack: list[list] = []  # [closing bracket, present key or index]
    at, line, counted, wants_key = 0, 1, 0, False
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            rest = _BETWEEN.match(text, at).end()
            if rest < len(text):
                yield None, f"malformed at {rest}", line + text.count("\n", counted, rest)
                return
            break
        line, counted, at = line + text.count("\n", counted, m.end()), m.end(), m.end()
        string, sign, scalar = m.groups()
        if sign in ("{", "["):
            stack.append(["}" if sign == "{" else "]", None if sign == "{" else 0])
            wants_key = sign == "{"
            continue
        if sign in ("}", "]"):
            if not stack or stack.pop()[0] != sign:
                yield None, f"malformed at {m.start(2)}", line
                return
        elif sign == ":":
            wants_key = False
            continue
        else:
            try:
                value = json.loads(string, strict=False) if string else scalar
            except ValueError:
                yield None, f"malformed at {m.start()}", line
                return
            if wants_key and stack and stack[-1][0] == "}":
                stack[-1][1] = value
                continue
            yield joined([s[1] for s in stack]), value, line
        # a value has ended: in an object a key follows, in an array the next index
        if stack:
            wants_key = stack[-1][0] == "}"
            if stack[-1][0] == "]":
                stack[-1][1] += 1
    if stack:
        yield None, "not closed", line


_YAML_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#:,\[\]{}&*!|>'"%@`-][^:#]*?|-[^\s:#][^:#]*?)\s*:(?=\s|$)\s*""")


def unquoted(x: str) -> str:
    x = x.strip()
    if len(x) > 1 and x[0] == x[-1] == "'":
        return x[1:-1].replace("''", "'")
    if len(x) > 1 and x[0] == x[-1] == '"':
        try:
            return json.loads(x, strict=False)
        except ValueError:
            return x[1:-1]
    return x


def _uncommented(x: str) -> str:
    """Without a trailing comment: a # behind a blank and outside quotes."""
    if "#" not in x:
        return x
    quote, i = None, 0
    while i < len(x):
        c = x[i]
        if quote:
            if c == "\\" and quote == '"' or c == quote == "'" and x[i + 1 : i + 2] == "'":
                i += 1  # what follows is part of the string
            elif c == quote:
                quote = None
        elif c in "\"'" and (i == 0 or x[i - 1] in " \t[{,:=("):
            quote = c
        elif c == "#" and (i == 0 or x[i - 1] in " \t"):
            return x[:i]
        i += 1
    return x


def of_yaml(text: str) -> Iterator[Row]:
    stack: list[list] = []  # [indent, key or index, whether an index]
    lines, n = text.split("\n"), 0
    while n < len(lines):
        raw, at = lines[n].rstrip("\r"), n + 1
        n += 1
        if raw.startswith(("---", "...")) and not raw[3:].strip():
            stack = []
            continue
        body = _uncommented(raw).rstrip()
        if not body.strip() or raw.startswith("%"):
            continue
        indent = len(body) - len(body.lstrip(" "))
        rest = body[indent:]
        while True:
            if rest == "-" or rest.startswith("- "):
                while stack and stack[-1][0] > indent:
                    stack.pop()
                if stack and stack[-1][2] and stack[-1][0] == indent:
                    stack[-1][1] += 1
                else:
                    stack.append([indent, 0, True])
                moved = len(rest) - len(rest[1:].lstrip(" "))
                indent, rest = indent + moved, rest[moved:]
                if rest:
                    continue
                break
            m = _YAML_KEY.match(rest)
            if m:
                while stack and stack[-1][0] >= indent:
                    stack.pop()
                stack.append([indent, unquoted(m[1]), False])
                rest = rest[m.end() :]
            break
        if not rest:
            continue
        if re.fullmatch(r"[|>][+-]?\d?[+-]?", rest):
            block = []
            while n < len(lines) and (not lines[n].strip() or len(lines[n]) - len(lines[n].lstrip(" ")) > (stack[-1][0] if stack else -1)):
                block.append(lines[n].strip())
                n += 1
            rest = "\n".join(block).rstrip("\n")
            yield joined([s[1] for s in stack]), rest, at
        elif stack:
            yield joined([s[1] for s in stack]), unquoted(rest), at


_TOML_KEY = re.compile(r"""\s*((?:[\w-]+|"(?:[^"\\]|\\.)*"|'[^']*')(?:\s*\.\s*(?:[\w-]+|"(?:[^"\\]|\\.)*"|'[^']*'))*)\s*""")
_TOML_PART = re.compile(r"""[\w-]+|"(?:[^"\\]|\\.)*"|'[^']*'""")


def of_toml(text: str) -> Iterator[Row]:
    table: list = []
    arrays: dict[str, int] = {}
    lines, n = text.split("\n"), 0
    while n < len(lines):
        body, at = _uncommented(lines[n].rstrip("\r")).strip(), n + 1
        n += 1
        m = re.fullmatch(r"(\[\[?)(.*?)(\]\]?)", body)
        if m and (k := _TOML_KEY.fullmatch(m[2])):
            parts = [unquoted(p) for p in _TOML_PART.findall(k[1])]
            table = []
            for i, p in enumerate(parts):  # tables below an array's belong to its last item
                table.append(p)
                name = joined(parts[: i + 1])
                if m[1] == "[[" and i == len(parts) - 1:
                    arrays[name] = arrays.get(name, -1) + 1
                if name in arrays:
                    table.append(arrays[name])
            continue
        k = _TOML_KEY.match(body)
        if not k or not body[k.end() :].startswith("="):
            continue
        value = body[k.end() + 1 :].strip()
        for mark in ('\"\"\"', "'''"):
            if value.startswith(mark) and mark not in value[3:]:
                while n < len(lines) and mark not in lines[n]:
                    value += "\n" + lines[n]
                    n += 1
                if n < len(lines):
                    value += "\n" + lines[n]
                    n += 1
        if value.startswith("["):
            depth = lambda v: v.count("[") - v.count("]")
            held, opened = [value], depth(value)
            while opened > 0 and n < len(lines):
                held.append(_uncommented(lines[n].rstrip("\r")).strip())
                opened += depth(held[-1])
                n += 1
            value = " ".join(held)
        if value[:3] in ('\"\"\"', "'''"):
            value = value[3 : value.rfind(value[:3]) if value.rfind(value[:3]) > 2 else None].removeprefix("\n")
        yield joined(table + [unquoted(p) for p in _TOML_PART.findall(k[1])]), unquoted(value), at


READERS = {"json": of_json, "yaml": of_yaml, "toml": of_toml}
SCHEMA = "path string, key string, value string, line long"


def key_paths(files: DataFrame) -> DataFrame:
    """path, language, text -> path, key, value and line of each scalar."""
    kind = pa.schema([("path", pa.string()), ("key", pa.string()), ("value", pa.string()), ("line", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "text")), strict=True):
                if rows := list(READERS[language](text)) if text else []:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(kind)[1:], strict=True))], schema=kind)

    return files.where(F.col("language").isin(*READERS)).select("path", "language", "text").mapInArrow(run, SCHEMA)


def config_references(keys: DataFrame, captured: DataFrame) -> DataFrame:
    """path, key, line, value, target: values that look like paths under keys that speak of one; target is the captured file (path) they name from the file's folder, or null."""
    last = F.regexp_extract("key", r'([^."]+)"?$', 1)
    asked = keys.where(last.rlike(PATH_KEY) & F.col("value").rlike(PATH_VALUE) & ~F.col("value").contains("\n") & ~F.col("value").rlike(r"^[a-z][a-z0-9+.-]*://"))

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = [posixpath.normpath(posixpath.join(posixpath.dirname(p), v)) for p, v in zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns, pa.array(full, pa.string())], [*b.schema.names, "full"])

    found = asked.mapInArrow(resolved, SCHEMA + ", full string")
    return found.join(captured.select(F.col("path").alias("target")).distinct(), F.col("full") == F.col("target"), "left").select("path", "key", "line", "value", "target")
