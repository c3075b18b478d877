"""Session helpers: the settings the engine relies on, package shipping and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def get_session(app: str = "runlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; extra settings by keyword with `_` for `.`."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_runlens_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="runlens-ship-"), "runlens_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, f"{_PACKAGE.name}/{file.relative_to(_PACKAGE)}")
    context.addPyFile(path)
    context._runlens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; in local mode (tests) a temporary one where it is unset."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = named or f"file://{tempfile.mkdtemp(prefix='runlens-checkpoint-')}"
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()
