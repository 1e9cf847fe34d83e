"""A folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that is unset a temporary folder stands for it, but only if driver and
    executors are one process: others would each write to a disk of their own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tallgrass-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        top = _OWN[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
