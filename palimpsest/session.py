"""Makes this package importable on every Python worker of a session."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import Config

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once per application; returns ``spark``."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{here.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(here.rglob("*.py")):
                out.write(source, source.relative_to(here.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; a folder of its own only where that is unset under a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise Config("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
