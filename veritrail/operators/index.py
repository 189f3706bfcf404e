"""BM25 over a written index: posting blocks with block maxima, by term-hash partition, searched with dynamic pruning.

Documents are dealt to ranges of about BLOCK documents of one corpus and alike length; a range is the unit that a search
takes or skips, so the blocks of all terms cut documents at the same places. A block holds the postings of one term in one
range and the largest impact among them: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)), which is the score without
the term's idf. Ranges are gathered in shelves; a row of the index is a term on a shelf, with its blocks in order of
falling maximum, maxima and postings in columns of their own. Rows lie in a folder for each hash of their term, so that a search reads the
folders of its terms alone, and at first their maxima only.

A search (block-max pruning):

1. The sum of idf * maximum over the query's terms bounds every score in a range. One row a range is made from maxima.
2. The ranges with the highest bounds are scored; their k-th best score is a threshold that the k-th best score of all reaches.
3. Of the other ranges those whose bound reaches the threshold are scored too. The rest can't hold a document of the result.

With `by_group` thresholds and results are those of each corpus. Results are exact; ties go to the smaller id.

Null and empty texts have no postings; both count in n, and empty ones in the mean length; null ids and corpora are kept like others; repeated ids are
told apart only if their corpus or length differs. Nothing but idf of at most MAX_TERMS terms and one row of totals comes to the driver.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veritrail.operators.graph import saved, shared_folder
from veritrail.operators.search import K1, B, terms_of

#: Documents of a range, ranges of a shelf, folders of the index, and terms of a query (the rest are passed over).
BLOCK, SHELF, FOLDERS, MAX_TERMS = 64, 64, 32, 24
#: Ranges that are scored first, in multiples of those that k documents would fill.
PROBE = 4
#: Tasks that an index is made in; each writes a file to each folder.
MAX_TASKS = 1024
#: Counts changes of the written form, so that an index of an older one isn't read.
FORMAT = 2
#: Sums of the same numbers in another order differ by less.
SLACK = 1e-9


def folder_of(term: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def impact(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, words, becomes two: its different words, and how often each occurs."""
    for batch in batches:
        words = batch.column(batch.num_columns - 1)
        flat = words.flatten().dictionary_encode()
        size = max(1, len(flat.dictionary))
        row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
        pair, tf = np.unique(row * size + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
        cuts = pa.array(np.searchsorted(pair, np.arange(len(words) + 1) * size), pa.int32())
        made = pa.ListArray.from_arrays(cuts, flat.dictionary.take(pa.array(pair % size))), pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "term", "tf"])


class PostingsIndex:
    """A written index at path: folders postings, totals."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.documents, self.mean, self.folders, schema = spark.read.parquet(f"{path}/totals").first()
        self.postings = spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{path}/postings")

    @classmethod
    def build(cls, chunks: DataFrame, path: str, id_col: str, text_col: str, group_col: str | None = None, folders: int = FOLDERS) -> PostingsIndex:
        spark = chunks.sparkSession
        group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
        words = chunks.select(F.col(id_col).alias("id"), group.alias("grp"), terms_of(F.col(text_col)).alias("w"))
        words = words.withColumn("length", F.when(F.col("w").isNotNull(), F.size("w")))
        words = words.withColumn("alike", F.floor(F.log2(F.col("length") + 1)))
        cells = saved(words.groupBy("grp", "alike").agg(F.count("*").alias("n"), F.sum("length").alias("words"), F.count("length").alias("told")))
        totals = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.sum("words"), F.sum("told")), F.lit(0.0)).alias("mean"))
        n, mean = totals.first()
        shelves = max(1, math.ceil(n / (BLOCK * SHELF)))
        place = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))
        same = words["grp"].eqNullSafe(cells["grp"]) & (words["alike"] == cells["alike"])
        placed = words.join(cells.select("grp", "alike", "n"), same).select("id", words["grp"], "length", F.xxhash64(words["grp"], words["alike"], place).alias("range"), "w").where(F.size("w") > 0)
        told = T.StructType([f for f in placed.schema.fields if f.name != "w"]).add("term", T.ArrayType(T.StringType())).add("tf", T.ArrayType(T.LongType()))
        # chunks are shuffled once, as their terms, to their shelf; all that follows is grouped where they then are
        shelved = placed.mapInArrow(tallied, told).withColumn("shelf", F.pmod("range", F.lit(shelves))).repartition(min(2 * shelves, MAX_TASKS), "shelf")
        each = shelved.select("id", "grp", "length", "range", "shelf", F.inline(F.arrays_zip("term", "tf")))
        tf = each.select("id", "grp", "length", "range", "shelf", F.col("term"), F.col("tf")).groupBy("shelf", "range", "term", "id", "grp", "length").agg(F.sum("tf").alias("tf"))  # an id's repeats
        blocks = tf.groupBy("shelf", "term", "range").agg(
            F.first("grp").alias("grp"), F.max(impact(F.col("tf"), F.col("length"), F.lit(mean))).alias("top"), F.collect_list(F.struct("id", "tf", "length")).alias("list")
        )  # a block: at most the documents of a range
        falling = F.sort_array(F.collect_list(F.struct("top", "range", "grp", "list")), asc=False)  # a shelf has about SHELF ranges
        rows = blocks.groupBy("shelf", "term").agg(falling.alias("b"))
        rows = rows.select(
            "term", "shelf", F.aggregate("b", F.lit(0).cast("long"), lambda acc, x: acc + F.size(x["list"])).alias("n"),
            F.transform("b", lambda x: F.struct(x["range"].alias("range"), x["grp"].alias("grp"), x["top"].alias("top"))).alias("tops"),
            F.transform("b", lambda x: x["list"]).alias("lists"), folder_of(F.col("term"), folders).alias("folder"),
        )
        totals.select("n", "mean", F.lit(folders).alias("folders"), F.lit(rows.schema.json()).alias("schema")).write.mode("overwrite").parquet(f"{path}/totals")
        rows.sortWithinPartitions("folder", "term", "shelf").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
        return cls(spark, path)

    def rows_of(self, terms: Sequence[str]) -> DataFrame:
        """The index's rows of these terms, from their folders alone."""
        asked = F.array(*[folder_of(F.lit(t), self.folders) for t in terms])
        found = sorted(set(self.spark.range(1).select(asked.alias("f")).first()[0]))
        return self.postings.where(F.col("folder").isin(found) & F.col("term").isin(list(terms)))

    def search(self, terms: Sequence[str], k: int, by_group: bool = False) -> Search:
        return Search(self, list(dict.fromkeys(t.lower() for t in terms))[:MAX_TERMS], k, by_group)


class Search:
    """One query: `found` (id, grp, score), at most k rows (of each corpus); `report` (asked, blocks, blocks_read, ranges, ranges_read)."""

    def __init__(self, index: PostingsIndex, terms: list[str], k: int, by_group: bool):
        self.index, self.rows = index, index.rows_of(terms or [""])
        counts = {r["term"]: r["n"] for r in self.rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each asked term
        self.idf = {t: math.log(1 + (index.documents - n + 0.5) / (n + 0.5)) for t, n in sorted(counts.items())}
        self.group = ["grp"] if by_group else []
        best = F.row_number().over(Window.partitionBy(*(self.group or [F.lit(0)])).orderBy(F.desc("bound"), "range"))
        tops = self.rows.select("shelf", self._weight(), F.explode("tops").alias("b")).select("shelf", "b.range", "b.grp", (F.col("weight") * F.col("b.top")).alias("top"))
        self.bounds = saved(tops.groupBy("shelf", "range", "grp").agg(F.sum("top").alias("bound"), F.count("*").alias("blocks")))
        least = PROBE * math.ceil(k / BLOCK) + PROBE
        first = saved(self.bounds.withColumn("place", best).where(F.col("place") <= least).drop("place"))
        scored = saved(self._scored(first))
        kth = self._best(scored, k).groupBy(*self.group).agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
        others = self.bounds.join(first.select("range", "shelf"), ["shelf", "range"], "left_anti")
        same = F.col("a.grp").eqNullSafe(F.col("b.grp")) if by_group else F.lit(True)
        reach = F.col("bound") * (1 + SLACK) + SLACK >= F.coalesce("least", F.lit(0.0))
        second = saved(others.alias("a").join(F.broadcast(kth.alias("b")) if not by_group else kth.alias("b"), same, "left").where(reach).select("shelf", "range", "a.grp", "bound", "blocks"))
        self.taken = first.unionByName(second)
        self.found = self._best(scored.unionByName(self._scored(second)), k)

    def _weight(self) -> Column:
        table = F.create_map(*[F.lit(x) for pair in (self.idf or {"": 0.0}).items() for x in pair])
        return F.try_element_at(table, F.col("term")).alias("weight")

    def _best(self, scored: DataFrame, k: int) -> DataFrame:
        order = [F.desc("score"), F.col("id")]
        if not self.group:
            return scored.orderBy(*order).limit(k)
        return scored.withColumn("place", F.row_number().over(Window.partitionBy(*self.group).orderBy(*order))).where(F.col("place") <= k).drop("place")

    def _scored(self, ranges: DataFrame) -> DataFrame:
        """(id, grp, score) of all documents of these ranges with a term of the query."""
        shelves = ranges.groupBy("shelf").agg(F.collect_set("range").alias("wanted"))  # about SHELF ranges at most
        rows = self.rows.join(shelves, "shelf").select(self._weight(), F.arrays_zip("tops", "lists").alias("z"), "wanted")
        kept = F.filter("z", lambda x: F.array_contains(F.col("wanted"), x["tops"]["range"]))
        blocks = rows.select("weight", F.explode(kept).alias("b")).select("weight", "b.tops.grp", F.explode("b.lists").alias("p"))
        part = F.col("weight") * impact(F.col("p.tf"), F.col("p.length"), F.lit(self.index.mean))
        return blocks.select("p.id", "grp", "p.length", part.alias("part")).groupBy("id", "grp", "length").agg(F.sum("part").alias("score")).select("id", "grp", "score")

    @property
    def report(self) -> DataFrame:
        """How much of the index the search has read: one row."""
        every = self.bounds.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.count("*").alias("ranges"))
        read = self.taken.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks_read"), F.count("*").alias("ranges_read"))
        return every.crossJoin(read).select(F.lit(len(self.idf)).alias("terms"), "blocks", "blocks_read", "ranges", "ranges_read")  # one row by one row


def version_of(chunks: DataFrame) -> str:
    """A digest of the files that chunks reads: their names, sizes and times."""
    files = chunks.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    mark = files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")).cast("string"), F.count("*")).first()
    return hashlib.sha256(":".join(map(str, mark)).encode()).hexdigest()[:32]


def index_of(chunks: DataFrame, id_col: str, text_col: str, group_col: str | None = None) -> PostingsIndex:
    """The index of chunks (read from files), built on first use of this version of the files and read again afterwards."""
    spark = chunks.sparkSession
    key = hashlib.sha256("|".join(map(str, (version_of(chunks), id_col, text_col, group_col, FORMAT, BLOCK, SHELF, FOLDERS))).encode()).hexdigest()
    path = f"{shared_folder(spark)}/index/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/postings/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return PostingsIndex(spark, path)
    return PostingsIndex.build(chunks, path, id_col, text_col, group_col)
