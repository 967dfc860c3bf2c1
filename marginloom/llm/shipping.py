"""Make this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the sources to the executors once per application (Spark serves them from the driver)."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="sources-"), "marginloom_llm_sources.zip")
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("marginloom/__init__.py", "")
        for folder in ("", "llm"):
            for name in sorted(os.listdir(os.path.join(_PACKAGE, folder))):
                if name.endswith(".py") and (folder or name != "__init__.py"):
                    archive.write(os.path.join(_PACKAGE, folder, name),
                                  os.path.join("marginloom", folder, name))
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)
