"""Tables of one run in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.session import shared_dir


class Scratch:
    """Written intermediate tables of one operator run.

    ``write`` cuts the lineage: what it returns is read from Parquet below
    ``spark.checkpoint.dir``, so a lost executor costs no recomputation of what
    came before.  ``drop`` removes a table once nothing needs it any more.
    """

    def __init__(self, spark: SparkSession, name: str, area: str = "tidelog-llm"):
        self.spark = spark
        self.root = shared_dir(spark, area, f"{name}-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.partitionBy(*[by] if by else []).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
