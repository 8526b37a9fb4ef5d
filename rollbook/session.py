"""Session helpers: sessions for local work, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rollbook")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster that doesn't have it installed."""
    import shutil
    from pathlib import Path

    package = Path(__file__).parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / "rollbook"), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rollbook-")
        sc.setCheckpointDir(root)
    return str(root)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def clean(spark: SparkSession) -> None:
    """Deletes the intermediate results that this process has stored; call it when their readers are done."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _made:
        p = path(_made.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a cut in the lineage that outlives executors.

    The shuffle files behind it aren't needed afterwards and are cleaned up at once.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "cut")
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._rollbook_path = path
    return out


def forget(*stored: DataFrame) -> None:
    """Deletes results of ``cut`` that nothing will read again."""
    for df in stored:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._rollbook_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(df._rollbook_path)
