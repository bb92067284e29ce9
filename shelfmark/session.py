"""Session helpers: table access, shared folders and checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that none needs it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    at = tempfile.mkdtemp(prefix="shelfmark-code-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    package = Path(__file__).resolve().parent
    shutil.copytree(package, Path(at, "src", package.name), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(at, "shelfmark_code")), "zip", Path(at, "src")))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name; ``sf_dir`` is any directory or URI of Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer bytes than one partition a core, cut into as many partitions as there are cores, for Python-heavy work; larger ones stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    widest = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if size >= cores * widest else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder for what jobs leave to each other, from ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a folder of its own; on a cluster a folder of
    one machine would not be seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs nothing."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
