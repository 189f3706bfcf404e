"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character n-grams of each order are hashed into a fixed number of buckets. Training counts buckets by language on a
sample of at most `per_language` documents of each language, drawn by a hash of id and text; the log-probability matrix
(buckets x languages, float32, at most MATRIX_BYTES: more languages get fewer buckets) is broadcast. Scoring hashes whole texts in batches: the n-grams of a batch form a
sparse matrix in row order whose product with the matrix is summed by document.

Defined results for odd input: null text and text without a letter give `und` with score 0; so does every text if no
row has a language to learn from; null languages are never learned; null and repeated ids are learned from like others,
equal rows (id, language and text) once; repeated rows are scored each; ties go to the language that sorts first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from veritrail.llm.common import small_batches, written

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
PER_LANGUAGE = 1500
#: Training texts beyond this many bytes are passed over (scoring has no such limit).
MAX_TRAIN_BYTES = 1 << 20
#: The matrix's size; beyond it buckets are halved, down to MIN_BUCKETS.
MATRIX_BYTES, MIN_BUCKETS = 64 << 20, 256
#: n-grams after which evidence no longer sharpens a score.
SHARP = 64
_CHARS = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(points: np.ndarray, order: int, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of the n-gram that starts at each place but the last order - 1."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    value = np.full(n, np.uint32(order))
    for k in range(order):
        value = (value ^ points[k : k + n]) * _MIX
        value ^= value >> np.uint32(15)
    return value & np.uint32(buckets - 1)


class Model:
    """log_prob: buckets x languages; prior: of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray, smoothing: float = 0.1):
        self.languages, self.buckets = languages, len(counts)
        likelier = counts + smoothing
        self.log_prob = np.log(likelier / likelier.sum(axis=0, keepdims=True)).astype(np.float32)
        self.prior = np.log(documents / documents.sum()).astype(np.float64)

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log-likelihood by language, and the number of n-grams, of each text."""
        out, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for k, text in enumerate(texts):
            points = code_points(text)
            for at in range(0, len(points), _CHARS):
                for order in ORDERS:
                    found = hashed(points[at : at + _CHARS + order - 1], order, self.buckets)
                    if len(found) > self.buckets:
                        out[k] += np.bincount(found, minlength=self.buckets) @ self.log_prob
                    else:
                        out[k] += self.log_prob[found].sum(axis=0, dtype=np.float64)
                    size[k] += len(found)
        return out, size

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [k for k, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            total, size = self.sums([texts[k] for k in known])
            total = (total + self.prior) * np.minimum(1, SHARP / size)[:, None]
            total = np.exp(total - total.max(axis=1, keepdims=True))
            total /= total.sum(axis=1, keepdims=True)
            for k, best, value in zip(known, total.argmax(axis=1), total.max(axis=1)):
                names[k], score[k] = self.languages[best], value
        return names, score


def counted(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    total = np.zeros(buckets, np.int64)
    for text in texts:
        points = code_points(text)
        for order in ORDERS:
            total += np.bincount(hashed(points, order, buckets), minlength=buckets)
    return total


def sampled(rows: DataFrame, by: str, per_group: int, key: list[str]) -> DataFrame:
    """At most per_group rows of each value of `by`: those with the smallest hash of the columns `key`. Rows that are equal
    in these are drawn once, and any number of them leaves no less room for others.

    Each task keeps the per_group smallest hashes of each group, as it goes; these are merged, and the last that
    counts is the group's threshold for the rows themselves."""
    placed = rows.withColumn("_vt_place", F.xxhash64(*[x for k in key for x in (F.col(k).isNull(), F.col(k))]))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            values = batch.column(0).dictionary_encode()
            own, places = values.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for k, value in enumerate(values.dictionary.to_pylist()):
                held[value] = np.unique(np.concatenate((held.get(value, places[:0]), places[own == k])))[:per_group]
        for value, places in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([value] * len(places), kind), pa.array(places)], names=[by, "_vt_place"])

    slim = placed.where(F.col(by).isNotNull()).select(by, "_vt_place")
    kind = to_arrow_type(slim.schema[by].dataType)
    kept = slim.mapInArrow(smallest, slim.schema).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_vt_place"))
    last = kept.withColumn("_vt_rank", rank).where(F.col("_vt_rank") <= per_group).groupBy(by).agg(F.max("_vt_place").alias("_vt_last"))
    last = written(last, "thresholds")  # a row for each group: its size is known, so Spark broadcasts it if it is small
    near = placed.join(last, by).where(F.col("_vt_place") <= F.col("_vt_last"))
    return near.dropDuplicates([by, "_vt_place"]).drop("_vt_place", "_vt_last")


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from the rows given. Each task counts its rows of the sample; counts are summed by language and bucket."""
    small_batches(rows.sparkSession)
    usable = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= MAX_TRAIN_BYTES))
    usable = usable.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = sampled(usable, "lang", per_language, ["id", "text"]).select("lang", "text")
    languages = max(1, rows.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().count())
    buckets = BUCKETS  # fewer with many languages, so that the matrix keeps its size
    while buckets > MIN_BUCKETS and 4 * buckets * languages > MATRIX_BYTES:
        buckets //= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = totals.setdefault(lang, [np.zeros(buckets, np.int64), 0])
                own[0] += counted([text], buckets)
                own[1] += 1
        for lang, (counts, n) in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * (len(at) + 1), "bucket": np.append(at, -1).astype(np.int32), "n": np.append(counts[at], n)},
                schema=pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]),
            )

    summed = picked.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = summed.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    found = by_lang.toArrow().sort_by("lang")  # a row for each language; packed counts of at most `buckets` + 1 each
    counts, documents = np.zeros((buckets, len(found))), np.ones(len(found))
    for k in range(len(found)):
        at, n = (found.column(c)[k].values.to_numpy() for c in ("bucket", "n"))
        counts[at[at >= 0], k] = n[at >= 0]
        documents[k] = n[at < 0].sum()
    return Model(found.column("lang").to_pylist(), counts, documents)


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs' rows with all their columns, pred_col and score_col; columns of those names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(pred_col, score_col)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = shared.value.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names, pred_col, score_col]
            )

    added = [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
