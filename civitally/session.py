"""Session defaults and layer storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "civitally", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def layer_root(spark: SparkSession) -> str:
    """Folder for materialised layers: the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="civitally-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes made inside delete their shuffle files as soon as they are done. Spark
    else keeps them until the driver's garbage collector comes by, so that the disk
    holds the shuffles of every layer at once."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def write_layer(df: DataFrame, path: str, *partitions: str, mode: str = "error") -> None:
    """Write ``df`` as Parquet that other steps read: compressed by zstd, which takes less
    disk than the default, and without leaving its shuffles behind."""
    writer = df.write.mode(mode).option("compression", "zstd")
    if partitions:
        writer = writer.partitionBy(*partitions)
    with shuffles_freed(df.sparkSession):
        writer.parquet(path)


class Layers:
    """Stores layers in a folder of their own; ``close`` deletes them."""

    def __init__(self) -> None:
        self.folders: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{layer_root(spark)}/civitally/{label}-{uuid.uuid4().hex}"
        self.folders.append((spark, path))
        write_layer(df, path)
        return spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for spark, path in self.folders:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        self.folders.clear()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that functions
    run in Python workers can be imported there whatever folder the driver is in."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="civitally-ship-")
    path = os.path.join(folder, "civitally.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as file:
        for base, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    file.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet layer and read it back.

    Used where several downstream aggregations read the same joined rows: the
    layer is computed once, survives lost executors and is column-pruned by
    each reader.
    """
    spark = df.sparkSession
    path = f"{layer_root(spark)}/civitally/{label}-{uuid.uuid4().hex}"
    write_layer(df, path)
    return spark.read.schema(df.schema).parquet(path)
