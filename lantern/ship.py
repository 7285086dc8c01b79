"""The package on Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package.

    Workers of a local master read it where it is. On a cluster the driver serves an archive of it, which every executor
    fetches once, those that replace a lost one too; only the driver reads the archive's file.
    """
    context = spark.sparkContext
    home = os.path.dirname(PACKAGE)
    if context.master == "local" or context.master.startswith("local["):
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(":") if p]
        if home not in paths:
            context.environment["PYTHONPATH"] = ":".join([home, *paths])
    elif "lantern.zip" not in context._python_includes:
        folder = tempfile.mkdtemp(prefix="lantern-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/lantern.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            for at, _, names in os.walk(PACKAGE):
                for name in sorted(names):
                    if name.endswith(".py"):
                        archive.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", home))
        context.addPyFile(f"{folder}/lantern.zip")
