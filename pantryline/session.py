"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}

# Work folders of this process, until they are cleared.
_FOLDERS: list[str] = []


def local_session(cores: str = "8", app: str = "pantryline", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one named in `spark.checkpoint.dir`.

    Every executor must see what one job writes and the next reads, so a
    machine-local folder is used only in local mode with the setting unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="pantryline-")
    path = f"{base.rstrip('/')}/pantryline-{purpose}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def clear_staged(spark: SparkSession) -> int:
    """Delete the work folders that this process has made, once nothing reads them any more."""
    n = len(_FOLDERS)
    for path in _FOLDERS:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _FOLDERS.clear()
    return n


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Compute `df` once, into the shared folder, and read it back.

    For intermediate results that a plan uses several times. The written table survives
    lost executors, and its known size lets Spark choose how to join it.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
