"""Gets this package to executors that don't have it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

_SHIPPED: weakref.WeakSet[SparkContext] = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once a context; executors fetch them from the driver."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    package, folder = Path(__file__).parent, tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/ledgerloom.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(f"{folder}/ledgerloom.zip")
    _SHIPPED.add(context)
