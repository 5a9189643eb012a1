"""Texts are made by as many tasks as the rows behind them ask for."""

from pyspark.sql import functions as F

from triage.plans.views import MANY_ROWS, view


def tasks_of(spark, path, n):
    """How many tasks make the Python files of ``n`` parts that stand in one small file."""
    spark.range(n).select(
        F.col("id").alias("p_partkey"), F.lit("a").alias("p_name"), F.lit("t").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size")
    ).coalesce(1).write.parquet(f"{path}/part.parquet")
    texts = view(spark, str(path), "v_py")
    assert texts.count() == n and texts.select("path").distinct().count() == n
    return texts.select(F.spark_partition_id()).distinct().count()


def test_a_small_file_of_wide_rows_is_shared(spark, tmp_path):
    assert tasks_of(spark, tmp_path / "few", 50) == 1
    assert tasks_of(spark, tmp_path / "some", 3_000) == 3
    assert tasks_of(spark, tmp_path / "many", 8 * MANY_ROWS) == 8  # more than the four cores
