"""A SparkSession with the settings that this library counts on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "tidemill", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their PYTHONPATH has it."""
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tidemill_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "tidemill.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "tidemill").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    sc._tidemill_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of checkpoints. Where none is set, an own one if all runs on this machine, else an error."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared ones."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


@contextmanager
def sized_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands rows to Python in batches bounded in bytes, since rows may be long; a longer row goes alone."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before) if before is not None else spark.conf.unset(BATCH)
