"""Cluster plumbing shared by all operators: shipping the package to executors and shared scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[tuple[str, str]] = set()
#: Local scratch folders of this process, which go with it.
_OWN: set[str] = set()
#: Rows and bytes of the Arrow batches that go to Python workers, where the session has Spark's defaults: documents are long, and
#: a batch is held several times over (by the JVM, the worker and its chunks).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "16777216")}


def configure(spark: SparkSession) -> None:
    """What an application (the entry, the pipeline) does once: smaller Arrow batches, unless the session sets its own.

    Operators never change settings of the session.
    """
    for key, (default, own) in BATCHES.items():
        if spark.conf.get(key, default).rstrip("b") == default:
            spark.conf.set(key, own)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it.

    Workers of a real cluster do not see the driver's source folder; ``addPyFile`` serves a small zip to them.
    """
    app = spark.sparkContext.applicationId
    if (app, "") in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessera-src-")
    target = os.path.abspath(os.path.join(folder, "tessera_src.zip"))
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add((app, ""))


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver's machine to the executors, once per application; workers find it by ``shipped_file``."""
    app = spark.sparkContext.applicationId
    path = os.path.abspath(path)
    if (app, path) not in _SHIPPED:
        spark.sparkContext.addFile(path)
        _SHIPPED.add((app, path))
    return os.path.basename(path)


def shipped_file(name: str) -> str:
    """Where a worker finds a file that ``ship_file`` sent."""
    return SparkFiles.get(name)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one only in local mode (tests) where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"tessera-scratch-{os.getpid()}")
        if found not in _OWN:
            _OWN.add(found)
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    system, where = _hadoop(spark, path)
    system.deleteOnExit(where)
    return path


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with files that survive the loss of an executor, and gives the next plan exact sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads, such as those of earlier rounds of an iteration."""
    for df in tables:
        spark = df.sparkSession
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if path.removeprefix("file://").removeprefix("file:").startswith(scratch_dir(spark).removeprefix("file://").removeprefix("file:")):
                system, where = _hadoop(spark, path)
                system.delete(where, True)
