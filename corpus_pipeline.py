"""From documents to token ids in five stages, each over all that its predecessor kept.

1. language ID: rejects documents without a letter and documents whose language stays in doubt (score under MIN_LANGUAGE);
2. quality classifier: rejects documents that score under MIN_QUALITY;
3. SimHash near-duplicates (5-word shingles, Jaccard similarity 0.8 or more): of each component one row stays, that with
   the smallest id (of rows that share it that with the smallest hash);
4. mixing: each document is repeated, or left out, as its source's target weight asks;
5. byte-level BPE: encodes what is left and decodes it again.

The first four return the columns of documents; the last one row for each document of the mix, with its token ids. Models are learned from
the stage's own input (and labels). Rows may share an id or have none: the third stage decides by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import bloom, bpe, langid, mil, mixing, simhash
from veritrail.llm.common import row_hashes, table, written

MIN_LANGUAGE = 0.4
MIN_QUALITY = 0.3
#: Jaccard similarity of 5-word shingle sets from which two texts are near copies: over, under.
SIMILARITY = (4, 5)


def _columns(frame: DataFrame, like: DataFrame) -> DataFrame:
    return frame.select(*[F.col(f"`{c}`") for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, "doc_id", "text", "lang")
    judged = langid.predict(docs, model, "text", "_vt_lang", "_vt_sure")
    return _columns(judged.where((F.col("_vt_lang") != langid.UNKNOWN) & (F.col("_vt_sure") >= MIN_LANGUAGE)), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = mil.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return _columns(mil.score(docs, model, "text", "_vt_quality").where(F.col("_vt_quality") >= MIN_QUALITY), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component. Rows are told apart by a key of the id and a hash of all columns, so rows that share an
    id, or have none, are decided one by one; rows with the same key are equal in every column."""
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), *[h.alias(n) for n, h in zip("gh", row_hashes(docs))])
    keyed = docs.withColumn("_vt_key", key)
    found = written(simhash.near_duplicates(keyed, "_vt_key", "text", shingle=5, similarity=SIMILARITY), "components")
    first = F.col("_vt_key") == F.col("component_id")
    kept = bloom.without(keyed, "_vt_key", found.where(~first).select("_vt_key"))
    repeated = found.where(first).groupBy("_vt_key").count().where("count > 1").select("_vt_key")
    return _columns(bloom.once(kept, "_vt_key", repeated), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken_documents(docs, "doc_id", "source", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id", "text", keep_ids=True)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("SimHash near-duplicates", near_duplicates),
    ("mixing to target weights", mix),
    ("byte-level BPE", encode),
]

#: Learned models, XXH64 fingerprints, drawn copies and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        docs = written(out, f"stage{number}") if number < len(STAGES) else out
    return docs
