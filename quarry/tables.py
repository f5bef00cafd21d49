"""Reading of the input tables and the session settings that every query relies on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a scale folder."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once a session, through the driver's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as staging:
        shutil.copytree(root, Path(staging, root.name), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        folder = tempfile.mkdtemp(prefix="package-")
        sc.addPyFile(shutil.make_archive(str(Path(folder, root.name)), "zip", staging))
    sc._quarry_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``. Where none is set, a local session (tests) takes a temporary one; a cluster must name a shared one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def clean_path(path: Column) -> Column:
    """``\\`` as ``/`` and no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+", "")


def clean_text(text: Column) -> Column:
    """CRLF and lone CR as one line feed."""
    return F.regexp_replace(text, r"\r\n?", "\n")
