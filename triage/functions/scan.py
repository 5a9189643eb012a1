"""Line scans over source text: one pass over the lines of one file.

The scans run inside the row of their text, on Arrow batches (``explode_texts``), so extracting symbols or
imports from a table of files needs no shuffle. A fold written as a column expression builds a
dozen structs for every line; here a line costs about a microsecond.

The scans know strings, comments, brackets and indentation, not the grammar.
Known limits: several statements on one line (``;``), a docstring on the line of
its ``def``, template literals that span lines, and regular expression literals.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from triage.functions.workers import ship

# What is removed from a line before brackets are counted. Group 1
# keeps the opening of a string that goes on over the line end.
PY_NOISE = (
    r'"""(?:[^"\\]|\\.|"(?!""))*"""'
    r"|'''(?:[^'\\]|\\.|'(?!''))*'''"
    r'|("""|' r"''').*$"
    r'|"(?:[^"\\]|\\.)*"'
    r"|'(?:[^'\\]|\\.)*'"
    r"|#.*$"
)
BRACE_NOISE = (
    r"/\*.*?\*/"
    r"|(/\*).*$"
    r'|"(?:[^"\\]|\\.)*"'
    r"|'(?:[^'\\]|\\.)*'"
    r"|`[^`]*`"
    r"|//.*$"
)

# Letters, digits and underscore of any script.
WORD = r"\p{L}\p{M}\p{N}_"
# Declarations by language; group 1 of each is the declared name.
PY_CLASS = r"^\s*class\s+([\p{L}\p{M}\p{N}_]+)"
PY_FUNCTION = r"^\s*(?:async\s+)?def\s+([\p{L}\p{M}\p{N}_]+)"
JS_CLASS = r"^\s*(?:export\s+)?(?:default\s+)?class\s+([\p{L}\p{M}\p{N}_]+)"
JS_FUNCTION = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([\p{L}\p{M}\p{N}_]+)"
JS_METHOD = (
    r"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*"
    r"(?!(?:if|for|while|switch|catch|function|return|with|do|else)\b)"
    r"(#?[\p{L}\p{M}\p{N}_]+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^={]+)?\{"
)
JAVA_CLASS = (
    r"^\s*(?:@[\p{L}\p{M}\p{N}_]+\s+)*(?:(?:public|private|protected|abstract|static|final|sealed|strictfp)\s+)*"
    r"class\s+([\p{L}\p{M}\p{N}_]+)"
)
JAVA_METHOD = (
    r"^\s*(?:@[\p{L}\p{M}\p{N}_]+\s+)*(?:(?:public|private|protected|abstract|static|final|synchronized|native|"
    r"default|strictfp)\s+)*(?:<[^>]*>\s*)?"
    r"(?!(?:new|return|else|throw|package|import|case)\b)"
    r"[\p{L}\p{M}\p{N}_.]+(?:<[\p{L}\p{M}\p{N}_<>\[\],.? ]*>)?(?:\[\])*\s+([\p{L}\p{M}\p{N}_]+)\s*\([^;{=]*\)?\s*(?:throws\s+[\p{L}\p{M}\p{N}_., ]+)?\s*(?:\{.*|;)?\s*$"
)
GO_TYPE = r"^type\s+([\p{L}\p{M}\p{N}_]+)"
GO_FUNCTION = r"^func\s+(?:\([^)]*\)\s*)?([\p{L}\p{M}\p{N}_]+)"

PY_MARKS = ("'''", '"""')
BRACE_MARKS = ("/*",)
PY_HINTS = ('"', "'", "#")
BRACE_HINTS = ('"', "'", "`", "/")

# White space of Java's patterns, and a string literal standing alone as the first statement of a body.
SPACE = " \t\n\x0b\f\r"
_DOC = (
    r"\A\s*([rRbBuUfF]*(?:"
    r'"""(?s:.*?)"""' r"|'''(?s:.*?)'''" r'|"(?:[^"\\\n]|\\.)*"' r"|'(?:[^'\\\n]|\\.)*'"
    r"))\s*?(?:#[^\n]*)?(?:\n|;|\Z)"
)

# start, end, name, kind, parent, line of the docstring or 0
Symbol = tuple[int, int, str, str, "str | None", int]


@cache
def _marks() -> str:
    """The combining marks (``\\p{M}``) as ranges of a character class."""
    found, out = [c for c in (*range(0x300, 0x20000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c))[0] == "M"], []
    for c in found:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


@cache
def _compiled(pattern: str) -> re.Pattern[str]:
    """A pattern as Java reads it: classes of letters, marks and numbers, white space of ASCII only."""
    return re.compile(pattern.replace(WORD, r"\w" + _marks()).replace(r"\s", f"[{SPACE}]"))


def _cleaner(noise: str, hints: tuple[str, ...], marks: tuple[str, ...]) -> Callable[[str, str], tuple[str, str]]:
    """What is left of a line as code, and the string or comment that is open behind it.

    ``quote`` is the delimiter that is pending before the line. Most lines hold nothing to remove.
    """
    remove = _compiled(noise).sub
    closers = {m: "*/" if m == "/*" else m for m in marks}

    def clean(x: str, quote: str) -> tuple[str, str]:
        if quote:
            at = x.find(closers[quote])
            if at < 0:
                return quote, quote
            x = remove(r"\1", x[at + len(quote):])
        else:
            for h in hints:
                if h in x:
                    x = remove(r"\1", x)
                    break
        for m in marks:
            if x.endswith(m):
                return x, m
        return x, ""

    return clean


def _brackets(code: str) -> int:
    count = code.count
    return count("(") + count("[") + count("{") - count(")") - count("]") - count("}")


def python_symbols(lines: list[str]) -> list[Symbol]:
    """Classes and functions of a Python file, by indentation.

    ``start`` is the line of ``class``/``def`` and ``end`` the last line of code
    before the next statement that is not indented deeper. A function anywhere
    below a class is a method of the nearest class. ``doc`` is the line where
    a docstring starts, or 0.
    """
    clean, is_class, is_def = _cleaner(PY_NOISE, PY_HINTS, PY_MARKS), _compiled(PY_CLASS).search, _compiled(PY_FUNCTION).search
    is_text = _compiled("^[rRbBuUfF]+[\"']").search
    quote, depth, joined, last, fresh = "", 0, False, 0, False
    open_: list[list] = []  # level, start, name, kind, parent, nearest class, doc
    done: list[Symbol] = []
    for ln, x in enumerate(lines, 1):
        t = x.lstrip(" \t")
        free = not quote and not depth
        starts = free and not joined and t != "" and t[0] != "#"
        code, quote = clean(x, quote)
        if starts:
            indent = x[: len(x) - len(t)]
            level = len(indent.replace("\t", " " * 8))
            named = kind = None
            if t.startswith("class"):
                named = is_class(x)
                kind = "class"
            elif t.startswith(("def", "async")):
                named = is_def(x)
            newest = open_[-1] if open_ else None
            if newest and any(o[0] >= level for o in open_):
                done += [(o[1], last, o[2], o[3], o[4], o[6]) for o in open_ if o[0] >= level]
                open_ = [o for o in open_ if o[0] < level]
            if named:
                above = open_[-1][5] if open_ else None
                name = named.group(1)
                if kind:
                    open_.append([level, ln, name, kind, None, name, 0])
                else:
                    open_.append([level, ln, name, "function" if above is None else "method", above, above, 0])
            elif fresh and newest and newest[0] < level and (t[0] in "\"'" or is_text(t)):
                newest[6] = ln
            fresh = named is not None
        if t and not (free and t[0] == "#"):
            last = ln
        depth = max(depth + _brackets(code), 0)
        joined = code.endswith("\\")
    return sorted(done + [(o[1], last, o[2], o[3], o[4], o[6]) for o in open_])


def brace_symbols(class_pattern: str, function_patterns: tuple[str, ...]) -> Callable[[list[str]], list[Symbol]]:
    """Classes and functions of a language with braces.

    A declaration ends on the line where the brace depth falls back to its own
    level, or on its own line when it has no body.
    """

    def scan(lines: list[str]) -> list[Symbol]:
        hint = "type" if class_pattern == GO_TYPE else "class"
        clean, find_class = _cleaner(BRACE_NOISE, BRACE_HINTS, BRACE_MARKS), _compiled(class_pattern).search
        finders = [_compiled(p).search for p in function_patterns]
        quote, depth, round_ = "", 0, 0
        open_: list[list] = []  # level, start, name, kind, parent, nearest class, entered
        done: list[Symbol] = []
        for ln, x in enumerate(lines, 1):
            named = held = None
            if not quote and not round_:
                held = find_class(x) if hint in x else None
                named = held or (next((m for f in finders if (m := f(x))), None) if "(" in x else None)
            code, quote = clean(x, quote)
            after = max(depth + code.count("{") - code.count("}"), 0)
            if named:
                above, name = open_[-1][5] if open_ else None, named.group(1)
                if held:
                    open_.append([depth, ln, name, "class", None, name, False])
                else:
                    open_.append([depth, ln, name, "function" if above is None else "method", above, above, False])
            if open_:
                enters, ends = "{" in code, code.rstrip(" ").endswith(";")
                still = []
                for o in open_:
                    o[6] = o[6] or enters
                    if after <= o[0] if o[6] else ends:
                        done.append((o[1], ln, o[2], o[3], o[4], 0))
                    else:
                        still.append(o)
                open_ = still
            depth = after
            round_ = max(round_ + code.count("(") - code.count(")"), 0)
        return sorted(done + [(o[1], len(lines), o[2], o[3], o[4], 0) for o in open_])

    return scan


def docstring(lines: list[str], start: int, end: int) -> str | None:
    """Leading string literal of a body with its quote characters stripped."""
    found = _compiled(_DOC).search("\n".join(lines[start - 1 : max(end, start - 1)]))
    return found.group(1).strip("\"'") if found else None


def import_statements(
    starts: str, noise: str, marks: tuple[str, ...], hints: tuple[str, ...]
) -> Callable[[list[str]], list[str]]:
    """Raw import statements in file order, at any depth.

    A statement goes on while a bracket is open or a line ends in a backslash.
    """

    def scan(lines: list[str]) -> list[str]:
        clean, begins = _cleaner(noise, hints, marks), _compiled(starts).search
        quote, depth, joined, text = "", 0, False, None
        done: list[str] = []
        for x in lines:
            if not quote and not depth and not joined and "import" in x and begins(x):
                text = x
            elif text is not None:
                text = f"{text}\n{x}"
            code, quote = clean(x, quote)
            depth = max(depth + _brackets(code), 0)
            joined = code.endswith("\\")
            if not depth and not joined:
                if text is not None:
                    done.append(text.strip(SPACE))
                text = None
        return done

    return scan


def explode_texts(
    files: DataFrame, keep: list[str], fields: str, scan: Callable[[str, list[str]], Iterable[tuple]]
) -> DataFrame:
    """``keep`` and ``fields`` of every row that ``scan`` finds by language and lines of a text; texts that are null give none."""
    ship(files.sparkSession)
    own = T.DataType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            texts = batch.column("content").cast(pa.binary())
            for i, language in enumerate(batch.column("language").to_pylist()):
                text = texts[i].as_py()
                if text is not None:
                    found = scan(language, text.decode("utf-8", "replace").splitlines())
                    rows += found
                    at += [i] * len(found)
            columns = [batch.column(c).take(pa.array(at, pa.int32())) for c in keep]
            values = list(zip(*rows, strict=True)) or [()] * len(own)
            kinds = [pa.int32() if f.dataType == T.IntegerType() else pa.string() for f in own]
            columns += [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *own.names])

    schema = T.StructType([*[files.schema[c] for c in keep], *own])
    wanted = list(dict.fromkeys([*keep, "language", "content"]))
    return files.select(*wanted).mapInArrow(run, schema)
