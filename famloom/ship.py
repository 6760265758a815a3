"""Getting the package to executors that do not have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of ``spark``, once an application, from wherever the driver was started.

    Not needed where it is installed on the executors or was given to spark-submit.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    # Executors fetch it from the driver whenever they start, so it stays as long as the driver runs.
    folder = tempfile.mkdtemp(prefix="famloom-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "famloom"), "zip", os.path.dirname(here), os.path.basename(here)))
