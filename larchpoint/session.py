"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # this package is itself imported from a shipped archive
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    where = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    where.write_bytes(data.getvalue())
    sc.addPyFile(os.fspath(where))
    _shipped.add(sc.applicationId)


def session(app: str = "larchpoint", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine expects; a running session is reused as it is."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
