"""Symbols (classes, functions, methods) of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.functions import scan

_SCRIPT = scan.brace_symbols(scan.JS_CLASS, (scan.JS_FUNCTION, scan.JS_METHOD))
_SCANS = {
    "python": scan.python_symbols,
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": scan.brace_symbols(scan.JAVA_CLASS, (scan.JAVA_METHOD,)),
    "go": scan.brace_symbols(scan.GO_TYPE, (scan.GO_FUNCTION,)),
}


def _symbols_of(language: str, lines: list[str]) -> list[tuple]:
    """The rows of one file: position, name, qualified name, kind, parent, lines, docstring."""
    if language not in _SCANS:
        return []
    return [
        (pos, name, name if parent is None else f"{parent}.{name}", kind, parent, start, end,
         scan.docstring(lines, doc, end) if doc else None)
        for pos, (start, end, name, kind, parent, doc) in enumerate(_SCANS[language](lines))
    ]


def extract(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per symbol of ``files(repo, commit_sha, path, language, content)``.

    A narrow transformation: no shuffle, and a file is handled whole in its row.
    ``pos`` is the position in the file; a nested class keeps its own name only. Columns
    named in ``keep`` go along.
    """
    return scan.explode_texts(
        files.where("language <> 'unknown'"), ["repo", "commit_sha", "path", *keep],
        "pos int, name string, qualified_name string, kind string, parent string, "
        "start_line int, end_line int, docstring string",
        _symbols_of,
    )


def all_symbols(symbol_lists: DataFrame, column: str = "symbols") -> DataFrame:
    """Flatten a column of symbol lists to one row per symbol."""
    rest = [c for c in symbol_lists.columns if c != column]
    return symbol_lists.select(*rest, F.explode(column).alias("s")).select(*rest, "s.*")
