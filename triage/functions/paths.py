"""Path column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(path: Column, root: Column) -> Column:
    """Part of ``path`` below ``root``; NULL when it lies outside."""
    base = F.concat(F.regexp_replace(root, r"/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1))


def directory(path: Column) -> Column:
    """Directory parts of a relative path, as an array."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def climb(parts: Column, levels: Column) -> Column:
    """Go up ``levels`` directories, stopping at the root."""
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - levels, F.lit(0)))


def normalise(parts: Column) -> Column:
    """Resolve ``.``, ``..`` and empty parts; NULL when ``..`` leaves the root."""
    def step(acc: Column, p: Column) -> Column:
        return (
            F.when(p.isin("", "."), acc)
            .when((p == "..") & (F.size(acc) == 0), F.lit(None))
            .when(p == "..", F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(p)))
        )

    return F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)


def drop_dots(parts: Column) -> Column:
    """Remove ``.`` and empty parts, keep ``..``."""
    return F.filter(parts, lambda p: ~p.isin("", "."))


def is_unsafe(path: Column) -> Column:
    """True for absolute paths and paths with a ``..`` part."""
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def suffix(path: Column) -> Column:
    """Extension with its dot; empty for none and for dot files such as ``.env``."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
