"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers of a session this package, once per application.

    Workers import the functions they run. Where the package is not installed on every node - or merely found through
    the driver's import path - it is sent along the way ``--py-files`` would.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="pathlight-package-")
    copy = shutil.copytree(_PACKAGE, Path(folder, "src", _PACKAGE.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder, _PACKAGE.name)), "zip", copy.parent))
    _shipped.add(context.applicationId)


def build_session(app_name: str = "pathlight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for; anything in ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Vectors are wide: smaller Arrow batches keep a Python worker's working set in its cache.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new empty location in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster its executors would not share it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share ({master} has no default)")
        shared = tempfile.mkdtemp(prefix="pathlight-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return os.path.join(shared, f"pathlight-{uuid.uuid4().hex}")
