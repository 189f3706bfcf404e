"""Sinks: tables, spools, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(chunks: DataFrame, path: str, corpus_col: str = "corpus_id") -> None:
    """Chunks partitioned by corpus, so that a search of one corpus reads that one only."""
    chunks.write.partitionBy(corpus_col).mode("overwrite").parquet(path)


def write_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings partitioned by a hash of the term: a query of few terms reads few folders."""
    postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_terms(spark, path: str, terms: Sequence[str], buckets: int = 64) -> DataFrame:
    """Postings of some terms from such an index; only their buckets are read."""
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    own = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most one for each asked term
    return spark.read.parquet(path).where(F.col("bucket").isin(own) & F.col("term").isin(list(terms)))


def spool(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def quality_report(metrics: dict, passed: bool) -> str:
    lines = ["# Graph quality", "", f"Passed: {passed}", "", "| metric | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in metrics.items())]
    return "\n".join(lines) + "\n"
