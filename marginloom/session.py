"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

# Settings that results depend on, or that the sinks rely on. Sizing (executors, memory, shuffle
# partitions) belongs to the cluster and is never set here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "marginloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_ROOT_LOCK = Lock()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables below the shared `spark.checkpoint.dir`.

    A machine-local folder is used only where the setting is absent *and* the master is local, so a
    cluster without a shared folder fails here instead of losing data with an executor later.
    """
    with _ROOT_LOCK:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
            root = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(**frames: DataFrame) -> dict[str, DataFrame]:
    """Write independent frames at the same time, so small jobs do not wait for each other."""
    if not frames:
        return {}
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        jobs = {name: pool.submit(materialize, df, name) for name, df in frames.items()}
        return {name: job.result() for name, job in jobs.items()}


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
