"""Tenant, key, service and policy relations from Parquet or a JDBC database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schemas import METADATA_TABLES


def read_metadata_files(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(METADATA_TABLES[table]).parquet(f"{root}/{table}")


def read_metadata_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Needs a JDBC driver on the class path.  Columns are cast to the fixed schema."""
    schema = METADATA_TABLES[table]
    df = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def write_metadata_files(df: DataFrame, root: str, table: str) -> None:
    """A new snapshot of one relation; readers of the old one should be done."""
    schema = METADATA_TABLES[table]
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("overwrite").parquet(f"{root}/{table}")
