"""Text column functions: lines, trimming, compression, token counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line breaks recognised in source text and logs.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
ODD_BREAK = r"[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
# Fixed value: one approximate token is a word or a single punctuation mark.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Fixed value: a line holding nothing but a comment.
FULL_LINE_COMMENT = r"^\s*#"


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A plain projection may be copied into the filters and lambda bodies above
    it, which for a split text means once per line. The output of an explode (of
    one element) is never copied, and it stays inside code generation.
    """
    keep = [c for c in df.columns if c not in columns]
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    held = df.select(*keep, F.explode(F.array(packed)).alias("_let"))
    return held.select(*keep, *[F.col("_let")[n].alias(n) for n in columns])


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once: ``let`` inside an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_lines(text: Column | str) -> Column:
    """Lines without their breaks; a final break adds no empty line.

    Nearly every text has line feeds only, and splitting on one character is
    several times faster than on a pattern.
    """
    text = F.col(text) if isinstance(text, str) else text
    feeds = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    body = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return (
        F.when(text == "", F.expr("cast(array() as array<string>)"))
        .when(text.rlike(ODD_BREAK), F.split(body, LINE_BREAK, -1))
        .otherwise(F.split(feeds, "\n", -1))
    )


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def line_range(lines: Column, start: Column, end: Column) -> Column:
    """Text of the 1-based inclusive line range."""
    n = F.greatest(end - start + 1, F.lit(0))
    return F.array_join(F.slice(lines, start, n), "\n")


def compress(text: Column | str) -> Column:
    """Drop comment-only lines and trailing space, squeeze runs of blank lines."""
    kept = F.filter(split_lines(text), lambda l: ~l.rlike(FULL_LINE_COMMENT))
    trimmed = F.transform(
        kept, lambda l: F.when(l.rlike(r"\s\z"), F.regexp_replace(l, r"\s+\z", "")).otherwise(l)
    )
    joined = F.regexp_replace(F.array_join(trimmed, "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"\A\n+|\n+\z", "")


def identity(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


# Names of the local compression strategies.
COMPRESSORS: dict[str, Callable[[Column], Column]] = {"rule_based": compress, "none": identity}


def compressor(strategy: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Look a strategy up by name, or take the caller's own column function."""
    if callable(strategy):
        return strategy
    if strategy not in COMPRESSORS:
        raise ValueError(f"unknown compression strategy {strategy!r}; known: {sorted(COMPRESSORS)}")
    return COMPRESSORS[strategy]


def count_tokens(text: Column | str, pattern: str = TOKEN) -> Column:
    """Approximate token count; NULL and empty text count 0.

    The exact vocabulary is a download, so every function that counts tokens
    takes a ``counter`` argument for a caller's own (Arrow-batched) counter.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.lit(0))


def count_words(text: Column | str) -> Column:
    """Tokens as white-space separated words (same in every SQL engine)."""
    return count_tokens(text, r"[^ \t\r\n]+")
