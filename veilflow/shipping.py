"""Workers need this package: where their path doesn't lead to it, it is sent to them."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a session's context, unless PYTHONPATH names its folder or, on one machine, the
    workers run in it."""
    sc = spark.sparkContext
    known = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if re.match(r"local(\[|$)", sc.master):
        known.add(Path.cwd().resolve())
    if HERE.parent in known or getattr(sc, "_veilflow_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="package-")) / "veilflow.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f.relative_to(HERE.parent))
    sc.addPyFile(str(path))
    sc._veilflow_shipped = True
