"""Problem 3: far too many small files -> few well-sized ones, every record once.

1. ``plan``: files are assigned to a fixed number of output groups, longest
   first, each to the least loaded group of a heap. The plan is made in
   buckets of files (by hash), so no task and no driver holds millions of
   file entries; each bucket owns as many groups as its bytes ask for, and
   groups are numbered through all buckets.
2. ``duplicates``: copies of a record share a 64-bit content hash; only rows
   whose hash occurs again are compared by 128 bits and by order. A hot record
   with a third of all rows is one partial count per task in the first step and
   one partial minimum in the second, never one group in one task.
3. ``compact``: every group's rows go to the task of its number (the heap's
   balance is kept, no hash stands between) and are streamed batch by batch
   through a pyarrow writer into one file per group, under a temporary name
   that is renamed when the group is complete. Rows are ordered by id, so a
   task that runs again writes the same file again. The manifest (one row per
   file: rows and a checksum of row ids) is written, verified against the
   input, and published by one rename.

Edge cases: groups without rows give no file; rows with null or unknown file
ids are spread over all groups by a hash of their id, so they are kept; an empty
table gives an empty manifest. A null row id takes part in no deduplication and
is kept. Column names starting with ``__`` are reserved.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mobilake.session import BROADCAST_LIMIT_BYTES, cut, qualified, work_path

_PLAN = "file_id bigint, bytes bigint, bucket int, slot int"


def longest_first(sizes: Sequence[int], groups: int) -> list[int]:
    """Group of each item: items by falling size, each into the least loaded group."""
    heap = [(0, g) for g in range(max(1, groups))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + sizes[i], g))
        out[i] = g
    return out


def _assign(pdf: pd.DataFrame, target: int) -> pd.DataFrame:
    pdf = pdf.sort_values("file_id", kind="stable").reset_index(drop=True)
    sizes = pdf["bytes"].tolist()
    pdf["slot"] = longest_first(sizes, -(-sum(sizes) // target))
    return pdf[["file_id", "bytes", "bucket", "slot"]]


def plan(files: DataFrame, file_id: str, size: str, target_bytes: int = 128 << 20, files_per_bucket: int = 50_000) -> DataFrame:
    """(file_id, bytes, bucket, slot) for every file; null or negative sizes count as 0, repeated ids once."""
    f = files.where(F.col(file_id).isNotNull()).groupBy(F.col(file_id).cast("bigint").alias("file_id")).agg(F.greatest(F.lit(0), F.coalesce(F.max(size), F.lit(0))).cast("bigint").alias("bytes"))
    n = files.count()
    buckets = max(1, -(-n // files_per_bucket))
    f = f.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))
    return f.groupBy("bucket").applyInPandas(lambda pdf: _assign(pdf, target_bytes), _PLAN)


def numbered(planned: DataFrame) -> tuple[DataFrame, int]:
    """(file_id, grp) with groups numbered from 0 through all buckets, and their number; one small row per bucket is summed up."""
    per = planned.groupBy("bucket").agg((F.max("slot") + 1).alias("k"))
    before = per.select("bucket", (F.sum("k").over(Window.orderBy("bucket")) - F.col("k")).alias("offset"))
    groups = per.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    return planned.join(F.broadcast(before), "bucket").select("file_id", (F.col("offset") + F.col("slot")).cast("int").alias("grp")), int(groups)


def leaves(df: DataFrame, skip: Sequence[str] = ()) -> list[Column]:
    """Columns of df with structs taken apart, so that every null is seen."""

    def walk(c: Column, t: T.DataType) -> list[Column]:
        if isinstance(t, T.StructType):
            return [c.isNull(), *[x for f in t for x in walk(c.getField(f.name), f.dataType)]]
        if isinstance(t, (T.MapType, T.VariantType)):
            return [F.to_json(F.struct(c.alias("m")))]
        return [c.isNull(), F.to_json(F.struct(c.alias("a")), {"ignoreNullFields": "false"}) if isinstance(t, T.ArrayType) else c]

    return [x for f in df.schema if f.name not in skip for x in walk(F.col(f"`{f.name}`"), f.dataType)]


def content_hashes(df: DataFrame, skip: Sequence[str]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes over all columns but ``skip``; null equals null and differs from every value."""
    cols = leaves(df, skip)
    return F.xxhash64(F.lit(17), *cols), F.xxhash64(F.lit(2_654_435_761), *reversed(cols))


def duplicates(df: DataFrame, row_id: str, skip: Sequence[str], order_us: Column, only: Column | None = None, broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(row_id) of all copies but the first by (order_us, row_id); nulls of order_us come last.

    ``only`` limits which rows can be copies. Hashes that occur more than once
    are written, counted and, if small, broadcast; then only the rows that
    bear one are shuffled. Neither step is skewed by many copies of one record.
    """
    rows = df.where(F.col(row_id).isNotNull() & (only if only is not None else F.lit(True)))
    one, two = content_hashes(df, skip)
    again = cut(rows.groupBy(one.alias("__h")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__h"), "hashes")
    again = _sized(again, again.count(), 16, broadcast_limit)
    near = rows.select(F.col(row_id).alias("__id"), one.alias("__h"), two.alias("__h2"), order_us.alias("__o")).join(again, "__h")
    order = F.struct(F.col("__o").isNull().alias("n"), F.col("__o").alias("o"), F.col("__id").alias("i"))
    near = cut(near, "copies")
    first = near.groupBy("__h", "__h2").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("__h").alias("a"), F.col("__h2").alias("b"), F.col("f.i").alias("__first"))
    return near.join(first, (F.col("__h") == F.col("a")) & (F.col("__h2") == F.col("b"))).where(F.col("__id") != F.col("__first")).select(F.col("__id").alias(row_id))


def _writer(schema: pa.Schema, root: str, grp: str, row_id: str):
    """mapInArrow function: the rows of one group -> one Parquet file and its row of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        tmp = f"{base}/data/.tmp-{uuid.uuid4().hex}"
        writer, group, n, total = None, None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                group = b.column(b.schema.get_field_index(grp))[0].as_py()
                writer = pq.ParquetWriter(tmp, schema, filesystem=fs, compression="zstd")
            t = pa.Table.from_batches([b]).drop_columns([grp]).cast(schema)
            writer.write_table(t)
            n += t.num_rows
            total += pc.sum(t.column(row_id)).as_py() or 0
        if writer is not None:
            writer.close()
            final = f"{base}/data/group-{group:010d}.parquet"
            fs.move(tmp, final)
            yield pa.RecordBatch.from_pydict({"grp": [group], "path": [final], "n_rows": [n], "id_sum": [total % (1 << 63)], "bytes": [fs.get_file_info(final).size]}, schema=MANIFEST)

    return run


MANIFEST = pa.schema([("grp", pa.int32()), ("path", pa.string()), ("n_rows", pa.int64()), ("id_sum", pa.int64()), ("bytes", pa.int64())])


def _sized(df: DataFrame, rows: int, row_bytes: int = 40, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast a table of a few numbers a row while it is small; larger ones are shuffled."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def compact(df: DataFrame, files: DataFrame, file_id: str, row_id: str, drop_ids: DataFrame | None = None, size: str = "n_bytes", target_bytes: int = 128 << 20, root: str | None = None) -> tuple[str, DataFrame]:
    """Write df, less drop_ids, as one Parquet file per output group; (folder, published manifest).

    Raises when the files do not hold every record exactly once; then nothing
    is published.
    """
    spark = df.sparkSession
    root = qualified(spark, root or work_path(spark, "compact"))
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(f"{base}/data", recursive=True)
    planned = cut(plan(files, file_id, size, target_bytes), "plan")
    p, n = numbered(planned)
    p = p.select(F.col("file_id").alias("__f"), F.col("grp").alias("__g"))
    id_of = F.col(row_id).cast("decimal(38,0)")
    total, id_sum = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(id_of), F.lit(0))).first()
    keep, names, id_sum = df, df.columns, int(id_sum)
    if drop_ids is not None:
        drop = cut(drop_ids.select(F.col(row_id).alias("__drop")).distinct(), "dropped")
        gone, gone_sum = drop.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("__drop").cast("decimal(38,0)")), F.lit(0))).first()
        total, id_sum = total - gone, id_sum - int(gone_sum)
        keep = df.join(_sized(drop, gone), F.col(row_id) == F.col("__drop"), "left_anti")
    n = max(1, n)
    lost = F.pmod(F.xxhash64(F.col(row_id)), F.lit(n)).cast("int")
    rows = keep.join(_sized(p, planned.count()), F.col(file_id).cast("bigint") == F.col("__f"), "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce("__g", lost).alias("__grp"))
    rows = rows.repartitionById(n, "__grp").sortWithinPartitions(row_id)
    schema = pa.schema([f if not pa.types.is_timestamp(f.type) or f.type.tz is None else pa.field(f.name, pa.timestamp("us", "UTC")) for f in to_arrow_schema(df.schema)])
    made = rows.mapInArrow(_writer(schema, root, "__grp", row_id), "grp int, path string, n_rows bigint, id_sum bigint, bytes bigint")
    made.write.parquet(f"{root}/_manifest_tmp")
    manifest = spark.read.schema(made.schema).parquet(f"{root}/_manifest_tmp")
    got = manifest.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.sum(F.col("id_sum").cast("decimal(38,0)")), F.lit(0)), F.count_distinct("path"), F.count(F.lit(1))).first()
    if got[0] != total or (int(got[1]) - id_sum) % (1 << 63) or got[2] != got[3]:
        raise RuntimeError(f"compaction of {total} rows gave {got[0]}; nothing published")
    fs.move(f"{base}/_manifest_tmp", f"{base}/manifest")
    return root, spark.read.schema(made.schema).parquet(f"{root}/manifest")


def removed_by_compaction(df: DataFrame, files: DataFrame, file_id: str, row_id: str, skip: Sequence[str], order_us: Column, only: Column, target_bytes: int = 128 << 20) -> DataFrame:
    """Compact, then name the rows of df that the published files hold in another copy."""
    root, _ = compact(df, files, file_id, row_id, duplicates(df, row_id, skip, order_us, only), target_bytes=target_bytes)
    kept = df.sparkSession.read.schema(T.StructType([df.schema[row_id]])).parquet(f"{root}/data")
    return df.select(row_id).join(kept, row_id, "left_anti")
