"""Shipping this package to the executors of a session."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from lexloom.tables import shared_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of the session's workers, once per application, so that
    queries run wherever the driver was started from. It travels through the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = f"{shared_dir(spark).rstrip('/')}/{root.name}-{uuid.uuid4().hex}.zip"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(held.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
