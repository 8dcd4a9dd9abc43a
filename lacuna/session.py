"""Session construction and the few settings every query relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "lacuna", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above, whose Python workers have this package; anything in ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.host", "127.0.0.1").config("spark.driver.memory", os.environ.get("LACUNA_DRIVER_MEMORY", "8g"))
    spark = builder.config(map={**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application: they may run where it is not installed or in another folder."""
    context = spark.sparkContext
    if getattr(context, "_lacuna_shipped", False):
        return
    here, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="lacuna-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it runs
    copy = Path(folder) / "package"
    shutil.copytree(here, copy / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{here.name}", "zip", copy))
    context._lacuna_shipped = True


def shipped(f: Callable) -> Callable:
    """``f(spark, ...)``, after :func:`ship`."""

    @wraps(f)
    def run(spark: SparkSession, *more):
        ship(spark)
        return f(spark, *more)

    return run
