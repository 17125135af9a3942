"""Pair tables (two genomic endpoints per row) as Spark DataFrame operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

__version__ = "0.1.0"


def ship(spark) -> None:
    """Makes this package importable by Python workers that don't find it by themselves, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_pairloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pairloom-"), "pairloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("pairloom", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._pairloom_shipped = True
