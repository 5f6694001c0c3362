"""Bronze, silver and gold folders: idempotent partitioned writes. [K1-K6, S21-S25]"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_partitions(df: DataFrame, path: str, keys: Sequence[str], files_rows: int = 5_000_000) -> None:
    """Replace exactly the partitions that df holds; others stay. [K2, K3, N9]

    A rebalance by the partition keys makes few, well-sized files and lets
    adaptive execution split a partition that is too large for one task.
    """
    out = df.hint("rebalance", *[F.col(k) for k in keys])
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", files_rows).partitionBy(*keys).parquet(path)


def append_bronze(df: DataFrame, path: str, moment: Column, batch: str) -> None:
    """Landed records as JSON lines under fecha=, hora= and the batch of the moment; a replayed batch replaces its own files and no others. [K1]

    Spark writes under hidden names that become visible when the job is
    committed, so a reader sees a batch whole or not at all.
    """
    keys = {"fecha": F.date_format(moment, "yyyy-MM-dd"), "hora": F.date_format(moment, "HH"), "lote": F.lit(batch)}
    df.withColumns(keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType, where: Column | None = None) -> DataFrame:
    """Root scan with a given schema and the predicate pushed to partitions; a missing folder is an empty table. [S21, S22, S25, N10-N12]"""
    try:
        df = spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], schema)
    return df if where is None else df.where(where)


def partitions(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct partition keys; from file listings alone, no data is read."""
    return df.select(*keys).distinct()


def write_report(report: DataFrame, path: str) -> None:
    """A quality report is as small as its suite: one JSON file. [K4, K5]"""
    report.coalesce(1).write.mode("overwrite").json(path)


def register(spark: SparkSession, name: str, path: str, schema: T.StructType) -> None:
    """A catalogue name for SQL over a folder. [S23]"""
    read_table(spark, path, schema).createOrReplaceTempView(name)


def upsert_table(old: DataFrame, new: DataFrame, path: str, keys: Sequence[str], keep_when_null: Sequence[str] = ()) -> None:
    """Keyed merge written beside the old table. [K6]"""
    from mobilake.operators.joins import upsert

    upsert(old, new, keys, keep_when_null).write.mode("overwrite").parquet(path)
