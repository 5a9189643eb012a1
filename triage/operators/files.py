"""File-level facts, filters and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.functions.paths import suffix
from triage.functions.scale import MAX_BROADCAST_ROWS
from triage.functions.text import split_lines

# Folders that never hold source, languages by suffix, code suffixes.
NOISE_DIRS = (
    ".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build",
    ".pytest_cache", ".mypy_cache", "vendor", ".tox", "egg-info",
)
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
}
CODE_SUFFIXES = (".py", ".js", ".ts", ".java", ".go", ".rb", ".cpp", ".c", ".rs", ".jsx", ".tsx")


def language(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    ext = F.lower(suffix(path))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ext), F.lit("unknown"))


def is_supported(path: Column | str) -> Column:
    return language(path) != "unknown"


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language("path"))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


def with_line_count(files: DataFrame) -> DataFrame:
    """Line feeds + 1, so a final line feed opens one more line."""
    text = F.col("content").cast("string")
    return files.withColumn(
        "line_count", F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    )


def in_noise_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in NOISE_DIRS]))


def keep_source_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Drop files in noise folders (judged by the relative path), and those over ``max_bytes`` where given."""
    kept = files.where(~in_noise_dir(F.col("path")))
    return kept if max_bytes is None else kept.where(F.col("length") <= max_bytes)


# --- ignore rules -----------------------------------------------------------------


def _glob_to_regex(rule: Column) -> Column:
    """Translate one cleaned ignore pattern to a regular expression on the path.

    Steps, in order: quote what is special in a regular expression, then turn
    ``**/``, ``/**``, ``*`` and ``?`` into their meaning. Placeholders (control
    characters) keep a later step from touching the result of an earlier one.
    """
    body = F.regexp_replace(rule, r"^/|/$", "")
    anchored = F.regexp_replace(rule, r"/$", "").contains("/")
    q = F.regexp_replace(body, r"([.+^${}()|\\])", r"\\$1")
    q = F.regexp_replace(q, r"\[!", "[^")
    q = F.regexp_replace(q, r"^\*\*/", "\u0001")
    q = F.regexp_replace(q, r"/\*\*/", "\u0002")
    q = F.regexp_replace(q, r"/\*\*$", "\u0003")
    q = F.regexp_replace(q, r"\*+", "[^/]*")
    q = F.regexp_replace(q, r"\?", "[^/]")
    q = F.replace(q, F.lit("\u0001"), F.lit("(?:.+/)?"))
    q = F.replace(q, F.lit("\u0002"), F.lit("/(?:.+/)?"))
    q = F.replace(q, F.lit("\u0003"), F.lit("/.+"))
    prefix = F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.+/)?"))
    tail = F.when(rule.endswith("/"), F.lit("/.+$")).otherwise(F.lit("(?:/.*)?$"))
    return F.concat(prefix, q, tail)


def ignore_rules(files: DataFrame) -> DataFrame:
    """One row per repository and commit: its root ``.gitignore`` as an ordered rule list.

    The list is as long as one file, so it is bounded by the file size limit.
    """
    text = F.col("content").cast("string")
    lines = F.transform(split_lines(text), lambda l: F.regexp_replace(l, r"(?<!\\)\s+$", ""))
    wanted = F.filter(lines, lambda l: (l != "") & ~l.startswith("#") & ~l.isin("/", "!"))

    def to_rule(line: Column) -> Column:
        negate = line.startswith("!")
        pattern = F.regexp_replace(F.regexp_replace(line, "^!", ""), r"^\\([#!])", "$1")
        return F.struct(_glob_to_regex(pattern).alias("regex"), negate.alias("negate"))

    return files.where(F.col("path") == ".gitignore").select(
        "repo", "commit_sha", F.transform(wanted, to_rule).alias("rules")
    )


def apply_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop ignored files; the last matching rule of the repository decides.

    Every file meets its repository's one rule row, never one row per rule. The
    rules are counted, and broadcast only while they are few in all.
    """
    kept = F.aggregate(
        F.coalesce("rules", F.array().cast(rules.schema["rules"].dataType)),
        F.lit(True),
        lambda acc, r: F.when(F.rlike(F.col("path"), r["regex"]), r["negate"]).otherwise(acc),
    )
    held = rules.agg(F.sum(F.size("rules"))).first()[0] or 0
    small = F.broadcast(rules) if held <= MAX_BROADCAST_ROWS else rules
    return files.join(small, ["repo", "commit_sha"], "left").where(kept).drop("rules")


# --- checks and totals ------------------------------------------------------------


def validate_repos(repos: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, n_files, has_code, valid, reason`` for every row of ``repos``.

    ``.git`` parts do not count as files; suffixes are compared case-sensitively.
    Files are counted before the join, so a huge repository is one small row.
    """
    counted = (
        files.where(~F.array_contains(F.split("path", "/"), ".git"))
        .groupBy("repo")
        .agg(
            F.count("*").alias("n_files"),
            F.bool_or(suffix(F.col("path")).isin(*CODE_SUFFIXES)).alias("has_code"),
        )
    )
    n, code = F.coalesce("n_files", F.lit(0)), F.coalesce("has_code", F.lit(False))
    return repos.select("repo").distinct().join(counted, "repo", "left").select(
        "repo",
        n.alias("n_files"),
        code.alias("has_code"),
        ((n > 0) & code).alias("valid"),
        F.when(n == 0, "empty").when(~code, "no code").alias("reason"),
    )


def summary(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files and symbols per commit."""
    keys = ["repo", "commit_sha"]
    f = files.groupBy(*keys).agg(F.count("*").alias("n_files"))
    s = symbols.groupBy(*keys).agg(F.count("*").alias("n_symbols"))
    return f.join(s, keys, "left").select(
        *keys, "n_files", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols")
    )


def index_files(files: DataFrame) -> DataFrame:
    """The file part of an index: language, hash and line count, ``content`` kept as text."""
    indexed = with_line_count(with_hash(with_language(files)))
    if isinstance(indexed.schema["content"].dataType, T.BinaryType):
        indexed = indexed.withColumn("content", F.col("content").cast("string"))
    return indexed
