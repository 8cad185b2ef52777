"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, which
    only a local master's driver and executors have in common."""
    key = "spark.lattica.shared.dir"
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends; until then results may read it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


class Cuts:
    """Intermediate tables of one traversal. A lost executor costs a re-read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lattica-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.mode("overwrite").parquet(path)
        if self.count == 1:
            delete_at_exit(self.spark, self.root)
        return self.spark.read.schema(df.schema).parquet(path)


def cutter(spark: SparkSession, name: str) -> Callable[[str, DataFrame], DataFrame]:
    """Writes a table, whatever it is called, and gives it back."""
    cuts = Cuts(spark, name)
    return lambda _, df: cuts.cut(df)
