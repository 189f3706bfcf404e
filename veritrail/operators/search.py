"""Lexical (BM25) and dense search as plans over postings and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
TERM = r"[\p{L}\p{N}_-]{2,}"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk_id, term, tf, length): an inverted index; write it partitioned by a hash of term to search it often."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), terms_of(F.col(text_col)).alias("w")).withColumn("length", F.size("w"))
    return words.select("chunk_id", "length", F.explode("w").alias("term")).groupBy("chunk_id", "term", "length").agg(F.count("*").alias("tf"))


def bm25(chunks: DataFrame, query_terms: list[str], id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """(id_col, kept columns, score) of the chunks with at least one query term. Term statistics come from all chunks.

    One pass counts the few query terms in each text without exploding it; statistics (one row) are broadcast:
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); score = sum idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))."""
    query_terms = list(dict.fromkeys(t.lower() for t in query_terms))[:24]
    words = chunks.select(id_col, *(keep or []), terms_of(F.col(text_col)).alias("_w"))
    wanted = F.array(*[F.lit(t) for t in query_terms]) if query_terms else F.array().cast("array<string>")
    hits = words.select(id_col, *(keep or []), F.size("_w").alias("_len"), F.filter("_w", lambda w: F.array_contains(wanted, w)).alias("_h"))
    times = lambda term: F.size(F.filter("_h", lambda w: w == term))
    tfs = [times(t).alias(f"_tf{k}") for k, t in enumerate(query_terms)]
    # inline keeps the filter below above it, so that no text is split again for each term of the filter
    counted = hits.select(id_col, *(keep or []), F.inline(F.array(F.struct("_len", *tfs))))
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), *[F.count_if(F.col(f"_tf{k}") > 0).alias(f"_df{k}") for k in range(len(query_terms))])
    score = F.lit(0.0)
    norm = K1 * (1 - B + B * F.col("_len") / F.col("_mean"))
    for k in range(len(query_terms)):
        tf, df = F.col(f"_tf{k}"), F.col(f"_df{k}")
        score = score + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm)
    found = counted.where(F.greatest(F.lit(0), F.lit(0), *[F.col(f"_tf{k}") for k in range(len(query_terms))]) > 0)
    return found.crossJoin(F.broadcast(stats)).select(id_col, *(keep or []), score.alias("score"))  # stats is one row


def totals_of(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (n, mean): the number and mean length of chunks with a term, as `bm25_by_postings` reads them off an index."""
    lengths = chunks.select(F.col(id_col).alias("chunk_id"), F.size(terms_of(F.col(text_col))).alias("length")).where("length > 0").distinct()
    return lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def bm25_by_postings(index: DataFrame, query_terms: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) for many queries (query_id, term) by a join with an inverted index, of which the asked terms alone are read.
    totals: the index's `totals_of`; without it they are counted, which reads the whole index."""
    n = totals if totals is not None else index.select("chunk_id", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    wanted = index.join(query_terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    asked = query_terms.distinct().join(df, "term").crossJoin(F.broadcast(n))
    met = wanted.join(asked, "term")
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return met.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_to(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """(id_col, dense_score) of the k most similar vectors, score = cosine; ties to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vector_col), q).alias("dense_score")).orderBy(F.desc("dense_score"), id_col).limit(k)


def hashing_embedding(text: Column, dimensions: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words."""
    words = F.transform(terms_of(text), lambda w: F.xxhash64(w))
    return F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda d: F.aggregate(
            words, F.lit(0.0), lambda acc, h: acc + F.when(F.pmod(h, F.lit(dimensions)) == d, F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)
        ),
    )
