import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("triage-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files of one repository from ``{path: content}``, with their language."""
    from triage.operators import files as fo

    def make(contents, repo="r", commit="c"):
        rows = [(repo, commit, p, len(t.encode()), t) for p, t in contents.items()]
        df = spark.createDataFrame(
            rows, "repo string, commit_sha string, path string, length long, content string"
        )
        return fo.with_language(df)

    return make
