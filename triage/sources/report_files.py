"""Read JSON test reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PHASE = T.StructType(
    [T.StructField("longrepr", T.StringType()), T.StructField("duration", T.DoubleType())]
)
SUMMARY = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("total", "passed", "failed", "error", "skipped")]
)
TEST = T.StructType(
    [
        T.StructField("nodeid", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("setup", PHASE),
        T.StructField("call", PHASE),
    ]
)
REPORT = T.StructType(
    [
        T.StructField("summary", SUMMARY),
        T.StructField("tests", T.ArrayType(TEST)),
    ]
)

# As read: a long text may be any JSON value, and a file may not be JSON at all.
_READ_PHASE = "struct<longrepr: variant, duration: double>"
_READ = (
    f"summary struct<{', '.join(f'{n}: long' for n in SUMMARY.names)}>, "
    f"tests array<struct<nodeid: string, outcome: string, setup: {_READ_PHASE}, call: {_READ_PHASE}>>, _broken string"
)


def _read(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Reports with their run: a folder ``run_id=...`` around the file, or else the file's name.

    With ``lines`` a file holds any number of reports, a line each: the run, a tab, the JSON text on one line.
    Listing, opening and committing a file per report costs the driver more than the reports do.
    """
    if lines:
        kept = F.from_json(F.expr("substr(value, instr(value, '\t') + 1)"), _READ, {"columnNameOfCorruptRecord": "_broken"})
        raw = spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("run_id"), kept.alias("_read"))
        return raw.select("_read.*", "run_id")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)
    folder = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), "/run_id=([^/]+)/[^/]+$", 1), F.lit(""))
    raw = spark.read.schema(_READ).option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken").json(path)
    return raw.withColumn("run_id", F.coalesce(folder, name))


def broken_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``run_id, tests_read`` of the files (or ``lines``) that end early or are no JSON, so that none reads as all-clear."""
    n = F.coalesce(F.size("tests"), F.lit(0))
    # Spark reads the mark of a broken record only together with another column: the filter needs both
    return _read(spark, path, lines).select("run_id", n.alias("tests_read"), "_broken").where("_broken is not null and tests_read >= 0").drop("_broken")


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per complete report file (or line, with ``lines``): ``run_id`` (file name without suffix), summary, tests.

    Missing counts are 0 and a missing test list is empty. A longrepr that is
    an object or a list instead of text is set to NULL; a text stays whatever it begins with.
    """
    summary = F.struct(
        *[F.coalesce(F.col(f"summary.{f}"), F.lit(0).cast("long")).alias(f) for f in SUMMARY.names]
    )

    def text_only(phase):
        is_text = F.schema_of_variant(phase["longrepr"]) == "STRING"
        text = F.when(is_text, F.try_variant_get(phase["longrepr"], "$", "string"))
        return F.when(
            phase.isNotNull(),
            F.struct(text.alias("longrepr"), phase["duration"].alias("duration")),
        )

    cleaned = F.transform(
        "tests",
        lambda t: F.struct(
            t["nodeid"].alias("nodeid"),
            t["outcome"].alias("outcome"),
            text_only(t["setup"]).alias("setup"),
            text_only(t["call"]).alias("call"),
        ),
    )
    tests = F.coalesce(cleaned, F.array().cast(T.ArrayType(TEST)))
    return _read(spark, path, lines).where("_broken is null").select("run_id", summary.alias("summary"), tests.alias("tests"))
