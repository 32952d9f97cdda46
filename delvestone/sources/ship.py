"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application.

    Functions and broadcast objects name their modules; without this they could
    be read only where the package is installed.  The driver's own copy is
    served to the executors by Spark, so that no folder need be shared.
    """
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="delvestone-"), "delvestone.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        out.write(whole, os.path.relpath(whole, os.path.dirname(root)))
        sc.addPyFile(path)
    _sent.add(sc.applicationId)
