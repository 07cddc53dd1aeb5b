"""Session helpers: building a session for tests and benches, and finding the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "quernstone") -> SparkSession:
    """A session on this machine, as tests and bench.py use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset (tests on one machine), a temporary folder is set."""
    sc = spark.sparkContext
    said = sc.getConf().get("spark.checkpoint.dir", None)
    if said is None:
        said = sc.getCheckpointDir()
    if said is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        said = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(said)
    return said


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lineage ends there, and the loss of an executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nothing refers to any more. Spark deletes them when the driver's JVM collects its garbage, which a driver with
    little garbage puts off, for longer than the disks of a large shuffle may bear."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator made, wherever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
