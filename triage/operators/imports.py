"""Import statements: extraction, parsing and resolution to files."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.functions import paths, scan
from triage.functions.scale import stage
from triage.functions.text import strip

# Where a statement starts, by language.
_PY_START = r"^\s*(?:import\s|from\s+(?!__future__\b)[\p{L}\p{M}\p{N}_.]+\s*import\b)"
_JS_START = r"^\s*import\b(?!\s*\()"
_JAVA_START = r"^\s*import\s"
_GO_START = r"^import\b"

# The spelling of an import, by language (whole statement text).
PY_FROM = r"^from\s+(\.*)([\p{L}\p{M}\p{N}_.]*)\s+import\s+(.+)$"
PY_PLAIN = r"^import\s+([\p{L}\p{M}\p{N}_.]+)"
JS_IMPORT = r"""^import\s+(?:.*\sfrom\s+)?['"]([^'"]+)['"]"""
JAVA_IMPORT = r"^import\s+(?:static\s+)?([\p{L}\p{M}\p{N}_.]+)\s*;?"
GO_IMPORT = r"""^["]?([\p{L}\p{M}\p{N}_./-]+)["]?$"""

# Files an import may mean, best first.
PY_VARIANTS = (".py", "/__init__.py")
JS_VARIANTS = (".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.ts")


def _go_specs(lines: list[str]) -> list[str]:
    """Each quoted path of an import declaration, with its alias if there is one."""
    out = []
    for statement in _GO_STATEMENTS(lines):
        body = re.sub(rf"^import[{scan.SPACE}]*\(?|\)[{scan.SPACE}]*$", "", statement)
        bare = [re.sub(rf"(^|[{scan.SPACE}])//.*$", "", line).strip(scan.SPACE) for line in body.split("\n")]
        out += [b for b in bare if '"' in b]
    return out


def _brace(starts: str) -> Callable[[list[str]], list[str]]:
    return scan.import_statements(starts, scan.BRACE_NOISE, scan.BRACE_MARKS, scan.BRACE_HINTS)


_GO_STATEMENTS = _brace(_GO_START)
_SCANS = {
    "python": scan.import_statements(_PY_START, scan.PY_NOISE, scan.PY_MARKS, scan.PY_HINTS),
    "javascript": _brace(_JS_START),
    "typescript": _brace(_JS_START),
    "java": _brace(_JAVA_START),
    "go": _go_specs,
}


def _statements_of(language: str, lines: list[str]) -> list[tuple]:
    return list(enumerate(_SCANS[language](lines))) if language in _SCANS else []


def extract(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw statements ``repo, commit_sha, path, language, pos, raw_import`` (and ``keep``). No shuffle."""
    return scan.explode_texts(
        files.where("language <> 'unknown'"), ["repo", "commit_sha", "path", "language", *keep],
        "pos int, raw_import string", _statements_of,
    )


def _parsed(language: Column, raw_import: Column) -> Column:
    raw = strip(raw_import)

    def parsed(module, names=None, dots=None, relative=None) -> Column:
        level = F.lit(0) if dots is None else F.length(dots)
        if relative is None:
            relative = level > 0
        no_names = F.expr("cast(array() as array<string>)")
        return F.struct(
            module.alias("module"),
            (no_names if names is None else names).alias("imported_names"),
            relative.alias("is_relative"),
            level.alias("relative_level"),
        )

    def first(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(raw, pattern, group)

    def name_of(n: Column) -> Column:
        return strip(F.substring_index(strip(n), " as ", 1))

    names = F.transform(F.split(first(PY_FROM, 3), ","), name_of)
    py_from = parsed(first(PY_FROM, 2), names, first(PY_FROM, 1))
    js, go = first(JS_IMPORT), first(GO_IMPORT)
    return (
        F.when((language == "python") & raw.rlike(PY_FROM), py_from)
        .when((language == "python") & raw.rlike(PY_PLAIN), parsed(first(PY_PLAIN)))
        .when(
            language.isin("javascript", "typescript") & raw.rlike(JS_IMPORT),
            parsed(js, relative=js.startswith(".")),
        )
        .when((language == "java") & raw.rlike(JAVA_IMPORT), parsed(first(JAVA_IMPORT)))
        .when((language == "go") & raw.rlike(GO_IMPORT), parsed(go, relative=go.startswith(".")))
    )


def parse(raw: DataFrame) -> DataFrame:
    """Add ``module, imported_names, is_relative, relative_level`` to raw statements.

    They are NULL for a spelling that is not understood: a Python import over
    several lines or an aliased Go import. ``import a, b`` keeps ``a`` only.
    """
    return raw.withColumn("_p", _parsed(F.col("language"), F.col("raw_import"))).select("*", "_p.*").drop("_p")


def _targets(all_names: bool) -> Column:
    """Path parts each statement may mean, as ``array<struct<slot, parts>>``.

    ``slot`` separates the names of ``from . import a, b``. They are tried in
    order for one edge, or get an edge each with ``all_names``.
    """
    base = F.col("base_dir")
    dotted = F.split("module", r"\.")
    python = (
        F.when(
            F.col("is_relative") & (F.col("module") == ""),
            F.transform(
                "imported_names",
                lambda n, i: F.struct(i.alias("slot"), F.concat(base, F.array(n)).alias("parts")),
            ),
        )
        .when(
            F.col("is_relative"),
            F.array(F.struct(F.lit(0).alias("slot"), F.concat(base, dotted).alias("parts"))),
        )
        .otherwise(F.array(F.struct(F.lit(0).alias("slot"), dotted.alias("parts"))))
    )
    script = F.array(
        F.struct(F.lit(0).alias("slot"), F.concat(base, F.split("module", "/")).alias("parts"))
    )
    return F.when(F.col("language") == "python", python).when(
        F.col("language").isin("javascript", "typescript") & F.col("is_relative"), script
    )


_SPEC = ["repo", "language", "base_dir", "module", "name_key", "is_relative"]


def _with_spec(parsed: DataFrame) -> DataFrame:
    """Reduce a statement to what decides its target.

    Absolute imports do not depend on the importing folder and only
    ``from . import a, b`` depends on its names, so ``import os`` in a million
    files is one specification.
    """
    relative = F.col("is_relative")
    climb = F.greatest(F.col("relative_level") - 1, F.lit(0))
    none = F.expr("cast(array() as array<string>)")
    return parsed.withColumn(
        "base_dir",
        F.when(relative, paths.climb(paths.directory(F.col("path")), climb)).otherwise(none),
    ).withColumn(
        "name_key",
        F.when(relative & (F.col("module") == ""), F.col("imported_names")).otherwise(none),
    )


def candidates(specs: DataFrame, all_names: bool = False, compat: bool = False) -> DataFrame:
    """Every file path a specification may mean, with its priority.

    ``compat`` leaves ``..`` in script imports unresolved and never takes a path
    as it is written; by default both are resolved.
    """
    py = F.array(*[F.struct(F.lit(i).alias("v"), F.lit(x).alias("end")) for i, x in enumerate(PY_VARIANTS)])
    tails = JS_VARIANTS if compat else ("", *JS_VARIANTS)
    js = F.array(*[F.struct(F.lit(i).alias("v"), F.lit(x).alias("end")) for i, x in enumerate(tails)])
    is_python = F.col("language") == "python"
    clean = paths.drop_dots(F.col("t.parts"))
    if not compat:
        clean = F.when(is_python, clean).otherwise(paths.normalise(F.col("t.parts")))
    names = F.col("name_key") if "name_key" in specs.columns else F.col("imported_names")
    return (
        specs.withColumn("imported_names", names)
        .select(*_SPEC, F.explode(_targets(all_names)).alias("t"))
        .select(*_SPEC, F.col("t.slot").alias("slot"), clean.alias("parts"))
        .where(F.size("parts") > 0)
        .select("*", F.explode(F.when(is_python, py).otherwise(js)).alias("x"))
        .select(
            *_SPEC,
            (F.col("slot") if all_names else F.lit(0)).alias("slot"),
            (F.col("slot") * 16 + F.col("x.v")).alias("prio"),
            F.concat(F.array_join("parts", "/"), F.col("x.end")).alias("cand_path"),
        )
    )


def resolve(
    parsed: DataFrame, files: DataFrame, all_names: bool = False, compat: bool = False
) -> DataFrame:
    """Add ``target`` (a path of the same repository or NULL) to parsed statements.

    Specifications are made distinct before their candidates meet the file
    table, so a module imported everywhere is looked up once. With ``all_names``
    a ``from . import a, b`` yields one row per resolved name.
    """
    # written once: the statements are read for the lookup and for its result
    statements = stage(_with_spec(parsed.where("module is not null")), "statements")
    specs = statements.select(*_SPEC).distinct()
    known = files.select("repo", F.col("path").alias("cand_path")).distinct()
    hits = (
        candidates(specs, all_names, compat)
        .join(known, ["repo", "cand_path"], "left_semi")
        .groupBy(*_SPEC, "slot")
        .agg(F.min(F.struct("prio", "cand_path")).alias("best"))
        .select(*_SPEC, F.col("best.cand_path").alias("target"))
    )
    return statements.join(hits, _SPEC, "left").drop("base_dir", "name_key")
