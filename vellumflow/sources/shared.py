"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _own() -> str:
    path = tempfile.mkdtemp(prefix="vellumflow-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run: in spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        top = _own()
    return f"{top.rstrip('/')}/vellumflow/{name}-{uuid.uuid4().hex}"
