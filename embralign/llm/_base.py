"""Scratch tables in the cluster's shared folder, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix=f"{package}-"), f"{package}_py.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, package)):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset an own one, in local mode only: executors elsewhere couldn't read it."""
    for value in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getConf().get("spark.checkpoint.dir", None)):
        if value:
            return value.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    return _OWN[app]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch on its way to Python; Spark's 64 MB are held twice by the executor and again by its worker.
BATCH_BYTES = 8 << 20


class Scratch:
    """Tables that cut lineage: written as Parquet to the shared folder and read back.

    The shuffles behind a table go as soon as it is written; else they stay until the driver happens to collect garbage.
    From the first one on, the session's Arrow batches are of at most BATCH_BYTES (a smaller limit stays).

    They survive the loss of executors. drop() removes one early; what is left goes when
    the driver's Python ends, since returned DataFrames still read from it.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if int(spark.conf.get(_BATCH).rstrip("bB")) > BATCH_BYTES:
            spark.conf.set(_BATCH, str(BATCH_BYTES))
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        kept = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(self.path(name))
        finally:
            self.spark.conf.set(_CLEANUP, kept)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            self._delete(self.root)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame, rows: int, each: int = 1 << 16) -> DataFrame:
    """df in no more tasks than that many rows ask for at `each` a task (8 at least); a large table keeps all its partitions.

    Small tables (edges, sizes, labels of a late round) otherwise pay for a task in each of many shuffle partitions.
    """
    return df.coalesce(min(max(8, -(-rows // each)), 1 << 24))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
