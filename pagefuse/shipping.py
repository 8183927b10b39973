"""Sends this package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Spark applications that have the package.
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source as a Python file of the session, once.

    Workers import it from there wherever they run; the archive is served by
    the driver, so no shared folder is needed.
    """
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="pagefuse-"), "pagefuse_source.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _DONE.add(app)
