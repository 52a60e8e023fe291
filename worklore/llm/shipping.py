"""Sends this package to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import worklore


def ship(spark: SparkSession) -> None:
    """Let Python workers import the package, also where it isn't installed; once per session.

    Rows here hold whole texts, so batches to Python hold fewer rows than by default.
    """
    context = spark.sparkContext
    if getattr(context, "_worklore_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(worklore.__file__))
    path = os.path.join(tempfile.mkdtemp(), "worklore-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                place = os.path.join(folder, name)
                z.write(place, os.path.join("worklore", os.path.relpath(place, root)))
    context.addPyFile(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context._worklore_shipped = True
