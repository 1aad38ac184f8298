"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Workers find the package by PYTHONPATH, or else (local masters) by a path that is handed to them, or (clusters) in a zip."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_sparkloom", False):
        return
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        known = context.environment.get("PYTHONPATH", "")
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), known]))
    else:
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/sparkloom", "zip", ROOT, "sparkloom"))
    context._sparkloom = True
