"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, with its scheme. In local mode it may be unset and is set here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return qualified(spark, found).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the store that Spark takes it for."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def put_file(folder: str, name: str, content: bytes) -> None:
    """Writes a file of a shared folder from a task, under a name of its own, then renames it: a task that runs twice does no harm."""
    parts = urlparse(folder)
    if parts.scheme in ("", "file"):
        os.makedirs(parts.path, exist_ok=True)
        part = f"{parts.path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, f"{parts.path}/{name}")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(content)


@contextmanager
def during(spark, name: str, value: str):
    """A setting for the jobs run inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark, size: str = "8m"):
    """Arrow batches of at most `size` for the jobs run inside: a worker holds a batch and its Python strings at a time."""
    return during(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive lost executors; drop() removes one early, the rest go when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strata-{uuid.uuid4().hex}"
        atexit.register(self._leave)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, *conditions: str) -> tuple[DataFrame, ...]:
        """table(), its number of rows, and those that meet each condition, told by the job that writes it: a job that counts costs the driver a plan of its own."""
        told = Observation()
        out = self.table(df.observe(told, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.expr(c)).alias(f"rows{k}") for k, c in enumerate(conditions))), name)
        found = told.get
        return out, found["rows"], *(found[f"rows{k}"] for k in range(len(conditions)))

    def drop(self, *names: str) -> None:
        for name in names:
            path = name if name.startswith(self.root) else self.path(name)
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _leave(self) -> None:
        try:
            self.drop(self.root)
        except (Py4JError, OSError, AttributeError):  # the session has ended before
            pass
