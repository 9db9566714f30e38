"""Sends the library to executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's Python path; Spark hands it to every executor, later ones too.

    The zip is made in a folder of the driver's own, from which Spark copies it.
    """
    here = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="millrace-ship-")) / "millrace.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"millrace/{f.relative_to(here)}")
    spark.sparkContext.addPyFile(str(out))
