"""Written tables in the shared folder that `spark.checkpoint.dir` names.

A staged table cuts lineage: lost executors reread files instead of recomputing a chain of shuffles, and
values such as partition numbers stay as they were when written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of the cluster; an own one only where the setting is absent, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not hasattr(spark, "_tickerloom_llm_folder"):
        spark._tickerloom_llm_folder = tempfile.mkdtemp(prefix="tickerloom-llm-")
    return spark._tickerloom_llm_folder


class Stages:
    """Tables written during one call of an operator; `drop` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self.number = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.number += 1
        path = f"{self.root}/{self.number}"
        df.write.parquet(path)
        staged = self.spark.read.schema(df.schema).parquet(path)
        staged._stage_path = path
        return staged

    def drop(self, staged: DataFrame) -> None:
        self.drop_path(staged._stage_path)

    def drop_path(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
