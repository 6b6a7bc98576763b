"""Getting this package to Python workers, wherever they start."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hands Spark a zip of the package, once an application; Spark sends it to the executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp()) / f"{root.name}.zip"  # stays while the driver runs: executors fetch it from there
    atexit.register(shutil.rmtree, to.parent, ignore_errors=True)
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
