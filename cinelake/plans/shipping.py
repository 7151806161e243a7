"""This package on the executors, wherever they are started."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from cinelake.plans.scratch import shared_dir, write_bytes

_SHIPPED: dict[str, str] = {}


def _archive() -> bytes:
    root = Path(__file__).resolve().parents[1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_bytes())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once for each application, through the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    data = _archive()
    path = f"{shared_dir(spark).rstrip('/')}/cinelake-{hashlib.sha256(data).hexdigest()[:16]}-{sc.applicationId}.zip"
    write_bytes(spark, path, data)
    sc.addPyFile(path)
    _SHIPPED[sc.applicationId] = path
