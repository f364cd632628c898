"""Session settings the operators are designed for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; all can be changed on a live session.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when the operator above wants the join's
    # own partitioning: the extra shuffle is cheaper than one huge task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

ROWS_PER_TASK = "mediatimeline.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 4_000_000


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use spark-submit's own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mediatimeline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def rows_per_task(spark: SparkSession) -> int:
    """Row count above which one group no longer goes to a single task."""
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a folder of our own only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


def settle(df: DataFrame) -> DataFrame:
    """Write rows once into the shared folder and read them back: ends the lineage, keeps the columns prunable."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession | None) -> None:
    """Send this package to the executors, once per session, so that Python functions run wherever it is not installed."""
    if spark is None:
        return
    context = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    name = f"{os.path.basename(root)}.zip"
    if name in context._python_includes:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
