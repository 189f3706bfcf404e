"""Citations of web answers: found in the answer's tree, limited to allowed domains, each url once, with the tier of its evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MOST_DOMAINS = 5
_DOMAIN = re.compile(r"[a-z0-9.-]+\.[a-z]{2,}")


def valid_domains(domains: Sequence[str]) -> list[str]:
    """Domains folded and made distinct, in order; refused if there are too many or one is no domain."""
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"at most {MOST_DOMAINS} domains can be allowed")
    folded = [d.strip().lower().lstrip(".") for d in domains]
    if bad := [d for d in folded if not _DOMAIN.fullmatch(d)]:
        raise ValueError(f"not a domain: {bad[0]}")
    return list(dict.fromkeys(folded))


def with_scheme(url: Column) -> Column:
    cleaned = F.trim(url)
    return F.when(cleaned == "", None).when(cleaned.rlike("(?i)^https?://"), cleaned).otherwise(F.concat(F.lit("https://"), cleaned))


def host_of(url: Column) -> Column:
    """The folded host, without user and port."""
    authority = F.regexp_extract(url, "(?i)^https?://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def within(host: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | F.endswith(host, F.lit("." + d))
    return out


def annotations(answer: Column, depth: int = 8) -> Column:
    """array<struct<url, title>> of the url citations of an answer in JSON, wherever they stand in it, in order of place."""

    @F.udf(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())])), useArrow=True)
    def found(text):
        import json

        def walk(x, left: int) -> Iterator[tuple]:
            if isinstance(x, dict):
                if x.get("type") == "url_citation" and x.get("url"):
                    yield str(x["url"]), None if x.get("title") is None else str(x["title"])
                x = list(x.values())
            if isinstance(x, list) and left:
                for y in x:
                    yield from walk(y, left - 1)

        try:
            return list(walk(json.loads(text), depth)) if text else []
        except ValueError:
            return []

    return found(answer)


def cited_sources(cited: DataFrame, domains: Sequence[str], tier: str, metadata_only: Sequence[str] = (), all_metadata: bool = False) -> DataFrame:
    """answer, place, url, host, title, source_type, metadata_only, evidence_tier of citations (answer, place, url, title).

    Urls without a scheme get https; hosts outside the domains are dropped; of an answer's equal urls the first stays; a title that is
    missing is the host. A host of a domain in metadata_only (or any, if all_metadata) gives metadata alone: no text of it may be quoted."""
    made = cited.withColumn("url", with_scheme(F.col("url"))).withColumn("host", host_of(F.col("url"))).where(within(F.col("host"), valid_domains(domains)))
    first = F.row_number().over(Window.partitionBy("answer", "url").orderBy("place"))
    thin = F.lit(all_metadata) | within(F.col("host"), metadata_only)
    kept = made.withColumn("_n", first).where("_n = 1").withColumn("metadata_only", thin)
    return kept.select(
        "answer", "place", "url", "host", F.coalesce(F.nullif("title", F.lit("")), "host").alias("title"), F.when(F.col("metadata_only"), "web_metadata").otherwise("web").alias("source_type"),
        "metadata_only", F.when(F.col("metadata_only"), "metadata").otherwise(tier).alias("evidence_tier"),
    )


def confidence(sources: DataFrame) -> DataFrame:
    """answer, n, confidence: 0.45 if all sources are metadata, 0.62 otherwise."""
    return sources.groupBy("answer").agg(F.count("*").alias("n"), F.when(F.bool_and("metadata_only"), 0.45).otherwise(0.62).alias("confidence"))
