"""Tables between steps: as few rows as there are patterns, written out so that what follows plans on a file instead of on all that came before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str | None:
    """A new path that all tasks share: in spark.checkpoint.dir, or in the warehouse where driver and tasks are one machine; else there is none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}" if root else None


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read back; kept in memory where there is no shared folder. Plans of seven rules in each of ten places would cost more than the rows."""
    path = folder(df.sparkSession, name)
    if path is None:
        return df.persist()
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
