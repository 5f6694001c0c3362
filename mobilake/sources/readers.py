"""Scans of landed files. [S10-S25]

Schemas are always given: an empty folder is an empty table, and a field that
is null in every record keeps its type. Where per-record keys matter, the raw
JSON text is kept beside the fields.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_arrays(spark: SparkSession, path: str, schema: T.StructType, raw: bool = False, recursive: bool = False) -> DataFrame:
    """Files holding a JSON array, or one object, of records. [S20, S24]

    The whole file is one value, so records are cut apart on the executors by
    the variant parser; ``raw`` keeps each record's own text as ``_raw``.
    """
    r = spark.read.option("wholetext", "true").option("recursiveFileLookup", str(recursive).lower())
    v = F.try_parse_json(F.col("value"))
    items = r.text(path).select(v.alias("v"))
    arr = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.when(F.schema_of_variant("v").startswith("OBJECT"), F.array("v")))
    one = items.select(F.explode(arr).alias("v")).select(F.to_json("v").alias("_raw"))
    out = one.select("_raw", F.from_json("_raw", schema).alias("r")).select("_raw", "r.*")
    return out if raw else out.drop("_raw")


def json_member(spark: SparkSession, path: str, member: str, schema: T.StructType) -> DataFrame:
    """Records under one member of a JSON document: records[], data.stations[], @graph[], features[]. [S15]"""
    doc = spark.read.option("wholetext", "true").text(path)
    items = F.try_variant_get(F.try_parse_json("value"), member, "array<variant>")
    return doc.select(F.explode(items).alias("v")).select(F.from_json(F.to_json("v"), schema).alias("r")).select("r.*")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """XML documents, one row per element. [S10-S12]"""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def semicolon_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """';'-separated text with a header, in Latin-1 or UTF-8 with or without mark. [S14]"""
    return spark.read.schema(schema).option("sep", ";").option("header", "true").option("enforceSchema", "true").option("encoding", encoding).csv(path)


def archive_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, member, content) of zip, tar and tar.gz archives, one member at a time. [S13, S16]

    An archive is one task; its members leave it one by one.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for where, data in zip(p["path"], p["content"]):
                for name, body in _members(bytes(data), suffix):
                    yield pd.DataFrame({"path": [where], "member": [name], "content": [body]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, member string, content binary")


def _members(data: bytes, suffix: str) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n in z.namelist():
                if n.endswith(suffix):
                    yield n, z.read(n)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile() and m.name.endswith(suffix):
                    yield m.name, t.extractfile(m).read()
    except tarfile.ReadError:
        return


def archive_rows(spark: SparkSession, path: str, member: str, schema: T.StructType, keys: Sequence[str] | None = None, column: str | None = None, batch: int = 10_000) -> DataFrame:
    """Rows of one comma-separated member of zip archives, streamed: neither the member nor its rows are ever held whole. [S16]

    keys: keep only rows whose ``column`` is one of them (a semi join inside the stream).
    """
    import csv

    names, wanted = schema.fieldNames(), None if keys is None else frozenset(keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for data in p["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z, z.open(member) as raw:
                    rows = csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                    kept = []
                    for r in rows:
                        if wanted is None or r.get(column) in wanted:
                            kept.append({n: r.get(n) for n in names})
                        if len(kept) == batch:
                            yield pd.DataFrame(kept, columns=names)
                            kept = []
                    if kept:
                        yield pd.DataFrame(kept, columns=names)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, text)
    return out.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def csv_member(members: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of comma-separated members, fields found by the header's names. [S16]"""
    import csv

    names = schema.fieldNames()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for body in p["content"]:
                rows = csv.DictReader(io.StringIO(bytes(body).decode("utf-8-sig")))
                batch = []
                for r in rows:
                    batch.append({n: r.get(n) for n in names})
                    if len(batch) == 10_000:
                        yield pd.DataFrame(batch, columns=names)
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=names)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    out = members.mapInPandas(run, text)
    return out.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


class _Scripts(HTMLParser):
    """Texts of the ld+json scripts of a page."""

    def __init__(self) -> None:
        super().__init__()
        self.inside, self.found = False, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.inside = tag == "script" and ("type", "application/ld+json") in attrs
        if self.inside:
            self.found.append("")

    def handle_endtag(self, tag: str) -> None:
        self.inside = self.inside and tag != "script"

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.found[-1] += data


def ld_json(page: Column) -> Column:
    """HTML text -> array of the JSON-LD texts it embeds. [S17]"""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(pages: pa.Array) -> pa.Array:
        out = []
        for p in pages.to_pylist():
            s = _Scripts()
            s.feed(p or "")
            out.append(s.found)
        return pa.array(out, pa.list_(pa.string()))

    return run(page)


def latest_resource(catalogue: DataFrame, group: str, keyword: str) -> DataFrame:
    """Newest CSV resource whose name holds the keyword. [S19, O4]"""
    d = catalogue.where(F.lower("name").contains(keyword.lower()) & (F.upper("format") == "CSV"))
    return d.groupBy(group).agg(F.max_by("url", F.struct(F.coalesce("last_modified", "created"), "url")).alias("url"))
