"""Session defaults, paths of any file system, and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tracewright", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TRACEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once: they need not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_tracewright_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tracewright-")) / "tracewright.zip"  # read on the driver, which serves it to the executors
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tracewright_shipped = True


def store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system that holds ``path``, and the path, as Hadoop knows them: local, remote or a bucket."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = store(spark, path)
    return files.exists(where)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewright-checkpoint-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*tables: DataFrame) -> None:
    """Delete what ``checkpointed`` wrote for ``tables``. Only for tables that nothing will read again, not even after a lost executor:
    whatever was made from them must be checkpointed itself."""
    for df in tables:
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            raise ValueError("not a checkpointed table")
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            files, where = store(df.sparkSession, file.get())
            files.delete(where, True)
