"""What Python workers need in order to run this package's functions."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master) is not None


def ship(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package: by path where they run on the driver's machine, else as an archive."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if is_local(spark):
        have = context.environment.get("PYTHONPATH", "")
        if root not in have.split(os.pathsep):
            context.environment["PYTHONPATH"] = root + (os.pathsep + have if have else "")
    elif context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        archive = os.path.join(tempfile.mkdtemp(prefix="ramify-"), "ramify.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(os.path.join(root, "ramify")):
                for name in names:
                    if name.endswith(".py"):
                        out.write(path := os.path.join(folder, name), os.path.relpath(path, root))
        context.addPyFile(archive)  # read by the executors from the driver


_shipped: set[str] = set()
