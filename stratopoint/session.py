"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(name: str = "stratopoint", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; pick a local one only when none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    if not named and not sc.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratopoint-ckpt-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, for data that tasks on all machines read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there.

    Reliable checkpoints survive a lost executor, which is why loops use this
    and not a cache.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """Tables of a loop in the checkpoint folder that are dropped when a later step replaces them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.folders: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and continue from there."""
        self.folders.append(shared_folder(self.spark, self.name))
        df.write.parquet(self.folders[-1])
        return self.spark.read.schema(df.schema).parquet(self.folders[-1])

    def drop(self) -> None:
        """Delete everything written so far; nothing that reads it may be run again."""
        for folder in self.folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = []


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors (once per application).

    Needed when it is imported from a checkout instead of being installed on
    the cluster: the sources travel as a zip through addPyFile.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="stratopoint-pkg-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
