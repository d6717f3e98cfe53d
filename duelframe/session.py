"""Session defaults and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", memory: str = "12g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("duelframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_path(spark: SparkSession) -> None:
    """Lets Python workers import this package, whatever the working folder is.

    On one machine the folder of the driver is enough; a cluster gets the package shipped as a file.
    """
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(root) in paths:
        return
    context.environment["PYTHONPATH"] = os.pathsep.join([str(root), *paths])
    if not context.master.startswith("local"):
        packed = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="duelframe-package-")) / "duelframe"), "zip", root, "duelframe")
        context.addPyFile(packed)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or the context's checkpoint directory names.

    Where both are unset, a session on one machine gets a temporary folder, which is removed at the end; on a cluster that is
    an error, since every executor would write its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="duelframe-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Intermediate tables written below the shared folder.

    A written table cuts the lineage as checkpoint() does, survives the loss of
    executors, and is computed once (an eager checkpoint computes its last stage
    twice). Tables that a result still reads are removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.clear)

    def save(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a saved table that no later step reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Delete all saved tables; without effect once the session has ended."""
        try:
            self._delete(self.root)
        except Exception:  # the gateway or the session is gone
            pass

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
