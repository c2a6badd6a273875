"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; a local default only for local masters, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/") + "/tables"


class Scratch:
    """Written tables of one query: each cuts the lineage, survives lost executors, and can be dropped.

    Tables that the returned result still reads stay until the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{root(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*sorted(self.names - set(names)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
