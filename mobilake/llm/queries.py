"""The queries of the problems on texts and records: p6, p8, p9, p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilake.llm import linkage, packing, stuffing, tokens
from mobilake.session import cut


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and the token ids of each document by byte_bpe_50k."""
    return _documents(spark, d).select("doc_id", tokens.encoder(spark)(F.col("text")).alias("ids"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one, with its container of 4,096 tokens."""
    sizes = _documents(spark, d).select("doc_id", tokens.counter(spark)(F.col("text")).alias("tokens"))
    return packing.pack(cut(sizes, "token-counts"), "doc_id", "tokens", 4096)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose pieces the packer put into more than one container: those it had to divide."""
    ends = p9_packed(spark, d).groupBy("doc_id").agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return ends.where("first < last").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the share of its text that is keyword stuffing, links or tags."""
    return _documents(spark, d).select("doc_id", stuffing.stuffing_share(F.col("text")).alias("share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents more than half of whose text is stuffing."""
    return _documents(spark, d).where(stuffing.is_stuffed(F.col("text"))).select("doc_id")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the same event in both agendas with a confidence, by venue, title and date alone."""
    r = spark.read.parquet(f"{d}/agenda_recintos.parquet")
    e = linkage.madrid_date(spark.read.parquet(f"{d}/agenda_eventos.parquet").select("event_id", "title", "start_datetime", "location"), "start_datetime", "date")
    left = linkage.records(r, "event_id", F.col("title"), F.col("venue_name"), F.try_to_date(F.col("start_datetime"), "yyyy-MM-dd"))
    right = linkage.records(e, "event_id", F.col("title"), F.col("location.venue_name"), F.col("date"))
    out = linkage.link(left, right, store=cut)
    return out.select(F.col("left_key").alias("recinto_event_id"), F.col("right_key").alias("evento_event_id"), "confidence")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs alone."""
    return p6_matches(spark, d).select("recinto_event_id", "evento_event_id")


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the matches: pairs once each, ids that exist, confidences from a half to one."""
    m = cut(p6_matches(spark, d), "matches")
    known = lambda t, c: spark.read.parquet(f"{d}/{t}.parquet").select(F.col("event_id").alias(c)).distinct().hint("merge")
    strange = m.join(known("agenda_recintos", "recinto_event_id"), "recinto_event_id", "left_anti").select("confidence").unionByName(m.join(known("agenda_eventos", "evento_event_id"), "evento_event_id", "left_anti").select("confidence"))
    twice = m.groupBy("recinto_event_id", "evento_event_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    n = lambda x, c: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("fault"), "n")
    return n(strange, "unknown id").unionByName(n(twice, "pair twice")).unionByName(n(m.where(~F.col("confidence").between(0.5, 1)), "confidence"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and those whose ids decode to their text."""
    docs = _documents(spark, d)
    back = docs.select(F.coalesce("text", F.lit("")).alias("text"), tokens.decoder(spark)(tokens.encoder(spark)(F.col("text"))).alias("back"))
    return back.agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("text") == F.col("back")).cast("bigint")).alias("equal"))


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing: every document, no container overfull, none divided that need not be."""
    p = cut(p9_packed(spark, d), "packed")
    per = p.where("tokens > 0").groupBy("container").agg(F.sum("tokens").alias("load"), F.count(F.lit(1)).alias("items"))
    docs = p.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.count_distinct("piece").alias("pieces"), F.max("pieces").alias("of"))
    faults = docs.where((F.col("k") != F.greatest(F.lit(1), F.ceil(F.col("t") / 4096))) | (F.col("k") != F.col("pieces")) | (F.col("k") != F.col("of")))
    n = lambda x, c: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("what"), "n")
    return n(docs, "documents").unionByName(n(per.where("load > 4096"), "overfull")).unionByName(n(faults, "faults"))


def p10_blank(spark: SparkSession, d: str) -> DataFrame:
    """The shares of null and empty texts and those of spaces alone, which are none."""
    return p10_shares(spark, d).join(_documents(spark, d).where(F.col("text").isNull() | (F.replace(F.col("text"), F.lit(" "), F.lit("")) == "")).select("doc_id"), "doc_id").select("doc_id", "share")


SQL = {
    "p6_invariants": "SELECT unnest(['unknown id','pair twice','confidence']) AS fault, CAST(0 AS BIGINT) AS n",
    "p8_roundtrip": "SELECT count(*) AS documents, count(*) AS equal FROM documents",
    "p9_invariants": "SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT unnest(['overfull','faults']), CAST(0 AS BIGINT)",
    "p10_blank": "SELECT doc_id, CAST(0 AS DOUBLE) AS share FROM documents WHERE text IS NULL OR replace(text,' ','')=''",
}
QUERIES = {"p6_found": p6_found, "p6_matches": p6_matches, "p8_ids": p8_ids, "p9_found": p9_found, "p9_packed": p9_packed, "p10_found": p10_found, "p10_shares": p10_shares, "p6_invariants": p6_invariants, "p8_roundtrip": p8_roundtrip, "p9_invariants": p9_invariants, "p10_blank": p10_blank}
