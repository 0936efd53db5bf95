"""Session helpers shared by every subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Lets Spark remove a query's shuffle files once the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only in local mode, where driver and tasks share their
    disk, a temporary folder is made and set if that is unset; on a cluster this is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="talweg-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Evaluates ``df`` once into the shared checkpoint folder and cuts its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to as many tasks as can run at once, if it is in fewer partitions; large tables stay as they are."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def _write(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` and reads it back; its shuffle files are not needed any more then and go at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one job in the shared folder, removed together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.count = spark, 0
        self.folder = f"{shared_dir(spark)}/talweg-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame) -> DataFrame:
        """Like ``stored``, until ``clear``."""
        self.count += 1
        return _write(df, f"{self.folder}/{self.count}")

    def clear(self) -> None:
        """Removes the tables.

        To be called when what was made from the tables is itself written: a lost executor must not need them.
        """
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Evaluates ``df`` once into a Parquet table in the shared folder and reads it back.

    Smaller than a checkpoint and readable by column, so for wide or large intermediate tables.
    """
    return _write(df, f"{shared_dir(df.sparkSession)}/talweg-{uuid.uuid4().hex}")
