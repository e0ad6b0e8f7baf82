"""Session helpers shared by every module: local sessions, table access and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "knotwork", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("KNOTWORK_DRIVER_MEMORY", "8g"),
    } | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below sf_dir. Paths go to Spark's reader as they are, so any store it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder that was made where none is set.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset on one machine (tests), one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        if not _made:
            _made.append("file://" + tempfile.mkdtemp(prefix="spark-knotwork-"))
        base = _made[0]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders of the tables that materialize() has written and nobody has deleted yet.
_written: list[str] = []


def materialize(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors.

    few: far fewer rows than what they are made from. They are brought together first, so that there are no more files than
    cores, unless files grow beyond the advised size: where Hadoop has no native library, an executor starts a process for
    each file and folder that it makes.
    """
    path = fresh_path(df.sparkSession, label)
    (df.hint("rebalance", df.sparkSession.sparkContext.defaultParallelism) if few else df).write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    """Through the file system that Spark writes to, so that a path without a scheme means the same one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read any more."""
    for spark, file in {(df.sparkSession, x) for df in tables for x in df.inputFiles()}:
        folder = next((w for w in _written if w.rpartition("/")[2] in file.split("/")), None)
        if folder:
            _written.remove(folder)
            _delete(spark, folder)


def written() -> list[str]:
    """The folders of the written tables that are still there."""
    return list(_written)


def discard_folders(folders: list[str], *kept: DataFrame) -> None:
    """Delete those of the written tables in folders that the kept ones don't read."""
    names = {part for df in kept for file in df.inputFiles() for part in file.split("/")}
    for folder in folders:
        if folder in _written and folder.rpartition("/")[2] not in names:
            _written.remove(folder)
            _delete(kept[0].sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Free the shuffle files of finished jobs, to be called once their DataFrames are out of reach.

    Spark removes them when the driver has collected their plans as garbage, which may be late; a job that shuffled much
    should not hold the executors' disks while the next one runs.
    """
    for _ in range(2):  # what the first round lets go of on the Python side, the second finds free on the other
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
