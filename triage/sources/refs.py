"""Classify references to repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.functions.text import strip

# Accepted spellings and the canonical address.
URL = r"^(https://github\.com/|git@github\.com:)([\w.-]+)/([\w.-]+?)(\.git)?/?$"
SHORTHAND = r"^([\w.-]+)/([\w.-]+)$"
LOCAL = r"^(/|\./|\.\./|~|file:)"
CLONE_URL = "https://github.com/%s/%s.git"


def classify_refs(df: DataFrame, column: str = "raw_input") -> DataFrame:
    """Add ``kind, owner, name, clone_url, local_path``.

    A reference is local by its prefix only: a column expression cannot look at
    the disk of whoever typed it. Unreadable references keep ``kind`` NULL.
    """
    raw = strip(F.col(column))
    local, url, short = raw.rlike(LOCAL), raw.rlike(URL), raw.rlike(SHORTHAND)

    def part(url_group: int, short_group: int) -> Column:
        return F.when(local, F.lit(None)).when(url, F.regexp_extract(raw, URL, url_group)).when(
            short, F.regexp_extract(raw, SHORTHAND, short_group)
        )

    return (
        df.withColumn(
            "kind",
            F.when(local, "local_path").when(url, "remote_url").when(short, "shorthand"),
        )
        .withColumn("owner", part(2, 1))
        .withColumn("name", part(3, 2))
        .withColumn(
            "clone_url",
            F.when(F.col("owner").isNotNull(), F.format_string(CLONE_URL, "owner", "name")),
        )
        .withColumn("local_path", F.when(local, F.regexp_replace(raw, r"^file:(//)?", "")))
    )


def quarantine(classified: DataFrame) -> DataFrame:
    """References that could not be read as any kind."""
    return classified.where("kind is null")


def repo_full_name(owner: Column, name: Column) -> Column:
    return F.concat_ws("/", owner, name)
