"""Getting this package to the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, as spark-submit --py-files would."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="storyweft-ship-"), "storyweft.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("storyweft", os.path.relpath(path, here)))
        spark.sparkContext.addPyFile(target)
    return spark
