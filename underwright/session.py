"""Session settings and the shared scratch area for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str | int | None = None, app: str = "underwright", **conf: str) -> SparkSession:
    """Session with the settings the library expects.

    Without ``cpus``, master, memory and shuffle partitions are those of the environment's Spark configuration. With it, the
    session is a local one of so many threads.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once per application, so that jobs may be started from any folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="underwright-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    _SHIPPED.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. A temporary local folder is used only
    where nothing is set and the session is a local one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="underwright-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
    return f"{configured.rstrip('/')}/underwright/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where several passes need the same rows: the table survives lost executors, keeps
    column pruning for the later passes and cuts the lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, parts: int, key: str, label: str) -> DataFrame:
    """``df`` written as ``parts`` even files, each in the order of ``key``: passes over it take as long as the largest file, and a rerun deals the same rows in the same order."""
    return materialise(df.repartition(parts, key).sortWithinPartitions(key), label)


def spread(df: DataFrame, *keys: str, per_core: int = 4) -> DataFrame:
    """``df`` dealt over all cores, for a step that makes many rows of each: the bytes that adaptive execution goes by don't tell its work.

    With ``per_core`` 1 there is one task a core, for a step whose tasks each load a large model.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores if per_core == 1 else max(per_core * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
