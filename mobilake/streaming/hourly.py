"""Streaming forms of the roll-ups. [T1-T11]"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mobilake.datasets.specs import Mart, gold, silver
from mobilake.session import BROADCAST_LIMIT_BYTES, cut
from mobilake.sources.layers import read_table, write_partitions


def file_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1000) -> DataFrame:
    """Landed Parquet files as a stream. [T1]"""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """A topic of JSON records; needs the Kafka package. [T9]"""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), "timestamp").select("r.*", "timestamp")


def windowed(stream: DataFrame, time: str, keys: Sequence[str], measures: Mapping[str, Column], length: str = "1 hour", lateness: str | None = "2 hours") -> DataFrame:
    """Tumbling windows on event time per key with a watermark; lateness None keeps the one the stream has. [T3, T4, T6]"""
    w = F.window(time, length)
    marked = stream.withWatermark(time, lateness) if lateness else stream
    out = marked.groupBy(w.alias("w"), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(*keys, F.col("w.start").alias("start"), *measures)


def once_each(stream: DataFrame, time: str, key: str, lateness: str = "1 day") -> DataFrame:
    """Repeats of a key within the watermark are dropped. [T7]"""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a list of days after its rows were counted."""
    return F.broadcast(df) if df.count() * 100 <= BROADCAST_LIMIT_BYTES else df


def land(stream: DataFrame, mart: Mart, silver_path: str, gold_path: str, checkpoint: str, processed_at: str, rejected_path: str, every: str | None = None) -> StreamingQuery:
    """Bronze stream to silver and gold; rejected rows are kept with their reasons. [T2, T5, T6, T8, T10]

    A batch rewrites the silver partitions it touches and recomputes gold of
    exactly these days (and of those whose trailing days they are). Each silver
    row carries the batch it came with, so a replayed batch replaces its own
    rows and equal rows of two batches stay two. Where the mart has a unique
    key, a key that silver already holds in a touched partition keeps its
    earliest row there, and later ones go to the rejected rows. An empty batch
    does nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        spark = rows.sparkSession
        good, bad = silver(mart, rows)
        good = cut(good.withColumn("_batch", F.lit(number).cast("bigint")), "good")
        day = mart.silver_keys[0]
        touched = cut(good.select(day).distinct(), "touched")
        old = read_table(spark, silver_path, good.schema).where(~F.col("_batch").eqNullSafe(number)).join(_few(touched), day, "left_semi")
        keep = good
        if mart.unique:
            known = old.select(F.col(mart.unique).alias("__known")).distinct()
            keep = good.join(known, F.col(mart.unique) == F.col("__known"), "left_anti")
            again = good.join(known, F.col(mart.unique) == F.col("__known"), "left_semi").drop("_batch")
            repeats = again.select(F.to_json(F.struct("*")).alias("record"), F.array(F.lit("duplicate_exact_content")).alias("reasons"))
        out = bad.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in bad.columns if c != "reasons"])).alias("record"), "reasons")
        out = out.unionByName(repeats) if mart.unique else out
        out.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        changed = cut(old.unionByName(keep), "merge")
        write_partitions(changed, silver_path, mart.silver_keys)
        changed = changed.drop("_batch")
        if mart.context_days:

            def near(before: int, after: int) -> DataFrame:
                d = F.to_date(F.col(day))
                span = touched.select(F.explode(F.sequence(F.date_sub(d, before), F.date_add(d, after))).alias("d"))
                return _few(cut(span.select(F.col("d").cast("string").alias(day)).distinct(), "days"))

            n = mart.context_days
            rows_near = read_table(spark, silver_path, good.schema).drop("_batch").join(near(n, n), day, "left_semi")
            g = gold(mart, rows_near, processed_at).join(near(0, n).withColumnRenamed(day, mart.gold_keys[0]), mart.gold_keys[0], "left_semi")
        else:
            g = gold(mart, changed, processed_at)
        write_partitions(g, gold_path, mart.gold_keys)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (q.trigger(processingTime=every) if every else q.trigger(availableNow=True)).start()


def keep_running(start: Callable[[], StreamingQuery], times: int = 3) -> StreamingQuery:
    """Start again after a failure, a bounded number of times. [T11]"""
    for k in range(times):
        q = start()
        try:
            q.awaitTermination()
            return q
        except Exception:  # noqa: BLE001
            if k == times - 1:
                raise
    raise ValueError("times must be at least 1")
