"""Tracebacks: the last block of a log text, its frames and its exception header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.functions.text import LINE_BREAK, let, split_lines, strip

# The standard traceback spelling.
HEADER = r"^Traceback \(most recent call last\):\s*$"
HEADER_IN_TEXT = (
    rf"(?:\A|{LINE_BREAK})Traceback \(most recent call last\):[^\S\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]*"
    rf"(?:\z|{LINE_BREAK})"
)
FRAME = r'^\s*File "([^"]+)", line (\d+), in (.+?)\s*$'
EXCEPTION = r"^([A-Za-z_][\w.]*)\s*:\s*(.*)$"
BARE_EXCEPTION = r"^([A-Za-z_][\w.]*)\s*$"
MARKER = r"^[\^~\s]+$"
UNKNOWN = "UnknownError"

# Line classes inside a block.
_BLANK, _FRAME, _END, _CODE, _MARKER = 0, 1, 2, 3, 4


def _line_class(line: Column) -> Column:
    return (
        F.when(~line.rlike(r"\S"), _BLANK)
        .when(line.rlike(FRAME), _FRAME)
        .when(~line.rlike(r"^[ \t]"), _END)
        .when(line.rlike(MARKER), _MARKER)
        .otherwise(_CODE)
    )


def _tail(items: Column, after: Column) -> Column:
    """Items behind the 1-based position ``after``."""
    return F.slice(items, after + 1, F.greatest(F.size(items) - after, F.lit(0)))


def parse(failures: DataFrame, text: str = "text", keep_all: bool = False) -> DataFrame:
    """Add ``exception_type, message, frames`` to rows whose text holds a traceback.

    Only the last block with a flush-left header counts. Rows without a header
    drop out, or stay with NULLs if ``keep_all``. Everything is computed inside
    the row of the text: no shuffle.
    """
    rows = failures if keep_all else failures.where(F.col(text).rlike(HEADER_IN_TEXT))
    lines = let(rows, _lines=split_lines(text))
    at = F.array_max(F.transform("_lines", lambda l, i: F.when(l.rlike(HEADER), i + 1).otherwise(0)))
    block = let(let(lines, _at=at), _block=_tail(F.col("_lines"), F.col("_at"))).drop("_lines")
    classed = let(block, _class=F.transform("_block", _line_class))
    # position of the first line behind the stack (block length + 1 if none)
    end = F.array_position("_class", _END).cast("int")
    ended = let(classed, _end=F.when(end == 0, F.size("_block") + 1).otherwise(end))
    stack = F.slice("_class", F.lit(1), F.col("_end") - 1)
    starts = F.filter(F.transform(stack, lambda c, i: F.when(c == _FRAME, i + 1)), lambda i: i.isNotNull())
    framed = let(ended, _starts=starts, _header=_header_lines())
    found = F.col("_at") > 0
    return let(
        framed,
        frames=F.when(found, _frames()),
        exception_type=F.when(found, _exception_type()),
        message=F.when(found, _message()),
    ).drop("_at", "_block", "_class", "_end", "_starts", "_header")


def _header_lines() -> Column:
    """Trimmed lines behind the stack, up to the first blank one."""
    body = _tail(F.col("_block"), F.col("_end") - 1)
    blank = F.array_position(_tail(F.col("_class"), F.col("_end") - 1), _BLANK).cast("int")
    until = F.slice(body, F.lit(1), F.when(blank == 0, F.size(body)).otherwise(blank - 1))
    return F.transform(until, lambda l: strip(l))


def _frames() -> Column:
    def code_line(start: Column, stop: Column) -> Column:
        lines = F.slice(F.col("_block"), start + 1, F.greatest(stop - start - 1, F.lit(0)))
        classes = F.slice(F.col("_class"), start + 1, F.greatest(stop - start - 1, F.lit(0)))
        at = F.array_position(classes, _CODE).cast("int")
        return F.when(at > 0, strip(F.element_at(lines, at)))

    def frame(start: Column, i: Column) -> Column:
        line = F.element_at(F.col("_block"), start)
        stop = F.coalesce(F.try_element_at(F.col("_starts"), i + 2), F.col("_end"))
        return F.struct(
            F.regexp_extract(line, FRAME, 1).alias("file_path"),
            F.regexp_extract(line, FRAME, 2).cast("int").alias("line_number"),
            F.regexp_extract(line, FRAME, 3).alias("function_name"),
            code_line(start, stop).alias("code_line"),
        )

    return F.transform("_starts", frame)


def _first_line() -> Column:
    return F.coalesce(F.try_element_at("_header", F.lit(1)), F.lit(""))


def _exception_type() -> Column:
    first = _first_line()
    return (
        F.when(first.rlike(EXCEPTION), F.regexp_extract(first, EXCEPTION, 1))
        .when(first.rlike(BARE_EXCEPTION), F.regexp_extract(first, BARE_EXCEPTION, 1))
        .otherwise(UNKNOWN)
    )


def _message() -> Column:
    first, rest = _first_line(), _tail(F.col("_header"), F.lit(1))
    lead = (
        F.when(first.rlike(EXCEPTION), F.regexp_extract(first, EXCEPTION, 2))
        .when(first.rlike(BARE_EXCEPTION), F.lit(""))
        .otherwise(first)
    )
    parts = F.filter(F.concat(F.array(lead), rest), lambda p: p != "")
    return strip(F.array_join(parts, " "))


def frames(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per stack frame, outermost first."""
    return parsed.select(*keys, F.posexplode("frames").alias("pos", "f")).select(*keys, "pos", "f.*")


def headers(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, "exception_type", "message")


def innermost(frames_: Column) -> Column:
    """Last frame, NULL if there is none."""
    return F.try_element_at(frames_, F.lit(-1))


def outermost(frames_: Column) -> Column:
    """First frame, NULL if there is none."""
    return F.try_element_at(frames_, F.lit(1))
