"""Give this package to the Python workers of a cluster."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from triage.functions.scale import stage_path

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put the package on the path of the workers, once per application: functions that run in
    tasks import it, and a worker has not the driver's path, not even on the same machine."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, str(source.relative_to(package.parent)))
    path = stage_path(spark, "package") + ".zip"
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    store, name = pafs.FileSystem.from_uri(uri)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name, compression=None) as f:
        f.write(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
