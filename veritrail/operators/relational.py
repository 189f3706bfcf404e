"""Relational operators that the retrieval and graph layers share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class Filters:
    """A conjunctive filter; fields that are empty or None don't restrict."""

    document_ids: Sequence = ()
    source_types: Sequence[str] = ()
    language: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    geography: Sequence[str] = ()
    domain: str | None = None
    min_confidence: float | None = None
    columns: dict[str, str] = field(default_factory=dict)

    def predicate(self) -> Column:
        """The filter as a column; columns maps field names to column names. A null confidence counts as 0."""
        c = lambda name: F.col(self.columns.get(name, name))
        keep = F.lit(True)
        ids = list(dict.fromkeys(self.document_ids))[:100]
        if ids:
            keep = keep & c("document_id").isin(ids)
        if self.source_types:
            keep = keep & c("source_type").isin(list(self.source_types))
        if self.language:
            keep = keep & (c("language") == self.language)
        if self.year_from is not None:
            keep = keep & (c("year") >= self.year_from)
        if self.year_to is not None:
            keep = keep & (c("year") <= self.year_to)
        if self.geography:
            keep = keep & F.arrays_overlap(c("geography"), F.array(*[F.lit(g) for g in self.geography]))
        if self.domain:
            keep = keep & c("domain").ilike(f"%{self.domain}%")
        if self.min_confidence is not None:
            keep = keep & (F.coalesce(c("confidence"), F.lit(0.0)) >= self.min_confidence)
        return keep


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both by key; a new value wins unless it is null. Keys are unique in each side."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], *[F.col(c).alias(f"_o_{c}") for c in rest])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_o_{k}"))
        on = same if on is None else on & same
    joined = new.join(o, on, "full_outer")
    return joined.select(*[F.coalesce(k, f"_o_{k}").alias(k) for k in keys], *[F.coalesce(c, f"_o_{c}").alias(c) for c in rest])


def merged_properties(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row for each key: of each column the last value that is not null, in the order given (ties: the greater value)."""
    picks = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c))))[c].alias(c) for c in columns]
    return rows.groupBy(key).agg(*picks)


def capped(rows: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    """At most `most` rows of each group, the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def diversified(rows: DataFrame, limit: int, score: str = "score", key: str = "chunk_id", document: str = "document_id", corpus: str = "corpus_id", per_document: int = 3, per_corpus: int = 8) -> DataFrame:
    """The best rows with at most per_document of a document and per_corpus of a corpus. A document has one corpus, so the
    greedy choice equals: rank in the document, then rank among survivors in the corpus, then the limit."""
    order = [F.desc(score), F.col(key)]
    first = capped(rows, document, order, per_document)
    return capped(first, corpus, order, per_corpus).orderBy(*order).limit(limit)


def fused(rankings: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion. rankings: corpus_id, channel, chunk_id, score, and other columns of the chunk.

    Returns a row for each chunk: rrf = sum of 1 / (60 + rank) over its lists, rrf_norm = rrf over the greatest rrf, and
    for each channel the greatest min-max-normalised score (1 in a list of equal scores other than 0)."""
    own = Window.partitionBy("corpus_id", "channel")
    ranked = rankings.withColumns({
        "rank": F.row_number().over(own.orderBy(F.desc("score"), "chunk_id")), "lo": F.min("score").over(own), "hi": F.max("score").over(own),
    })
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).when(F.col("score") != 0, 1.0).otherwise(0.0)
    rest = [c for c in rankings.columns if c not in ("channel", "chunk_id", "score")]
    by_chunk = ranked.withColumn("norm", norm).groupBy("chunk_id").agg(
        *[F.min(c).alias(c) for c in rest],
        F.sum(1.0 / (60 + F.col("rank"))).alias("rrf"),
        *[F.coalesce(F.max(F.when(F.col("channel") == ch, F.col("norm"))), F.lit(0.0)).alias(f"{ch}_norm") for ch in ("dense", "bm25")],
        *[F.max(F.when(F.col("channel") == ch, F.col("score"))).alias(f"{ch}_score") for ch in ("dense", "bm25")],
    )
    # the greatest rrf is among the rows that the limit keeps, so a window over those few replaces a second pass over all
    best = by_chunk.orderBy(F.desc("rrf"), "chunk_id").limit(limit)
    return best.withColumn("rrf_norm", F.col("rrf") / F.max("rrf").over(Window.partitionBy(F.lit(0)))).orderBy(F.desc("rrf"), "chunk_id")


def slot_coverage(results: DataFrame, slots: Sequence[str], slots_col: str = "matched_slots") -> DataFrame:
    """slot, n, state: covered by two results or more, weak by one, missing by none."""
    spark = results.sparkSession
    wanted = spark.createDataFrame([(s,) for s in slots], "slot string")
    counts = results.select(F.explode(slots_col).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    state = F.when(F.col("n") >= 2, "covered").when(F.col("n") == 1, "weak").otherwise("missing")
    return wanted.join(counts, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).cast("long").alias("n")).withColumn("state", state)


def round_robin(rows: DataFrame, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Rows taken from the groups in turn, each in its own order, until limit."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.orderBy("turn", group).limit(limit)


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int = 10) -> DataFrame:
    """Page `number` (from 1) of rows in the order given."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


#: Sets of up to so many members are indexed by all pairs of them (about n^2 / 2), larger ones by each member.
PAIRED = 64


def maximal_sets(groups: DataFrame, id_col: str, members_col: str) -> DataFrame:
    """Drops groups whose members are a strict subset of another's. Equal sets are compared once. A set of one member is covered if a larger
    set holds that; others meet only those larger sets that hold their two rarest members (of sets over PAIRED: the rarest), where the join tests
    containment. Groups without members stay. All joins are sorted ones: sets are never gathered in one place."""
    sets = groups.select(F.array_sort(F.array_distinct(members_col)).alias("s")).distinct()
    member = sets.where(F.size("s") > 0).select("s", F.explode("s").alias("m"))
    often = member.groupBy("m").agg(F.count("*").alias("n"), F.max(F.size("s")).alias("largest"))
    met = member.join(often.withColumnRenamed("m", "_m").hint("merge"), F.col("m").eqNullSafe(F.col("_m")))
    known = met.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("r"), F.min("largest").alias("largest"))
    single = known.where((F.size("s") == 1) & (F.col("largest") > 1)).select("s")
    asked = known.where((F.size("s") > 1) & (F.col("largest") > F.size("s"))).select("s", F.get("r", 0)["m"].alias("m"), F.get("r", 1)["m"].alias("m2"))
    pair = lambda a, b: F.xxhash64(F.least(a, b), F.greatest(a, b))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: pair(x, y))))
    larger = sets.select(F.col("s").alias("t"))
    small = larger.where((F.size("t") > 2) & (F.size("t") <= PAIRED)).select("t", F.explode(F.array_distinct(pairs)).alias("k"))
    big = larger.where(F.size("t") > PAIRED).select("t", F.explode("t").alias("_m"))
    holds = (F.size("t") > F.size("s")) & (F.size(F.array_intersect("s", "t")) == F.size("s"))
    covered = asked.select("s", pair(F.col("m"), F.col("m2")).alias("k")).join(small.hint("merge"), "k").where(holds).select("s")
    covered = covered.union(asked.select("s", "m").join(big.hint("merge"), F.col("m").eqNullSafe(F.col("_m"))).where(holds).select("s")).union(single).distinct()
    keyed = groups.withColumn("_s", F.array_sort(F.array_distinct(members_col)))
    return keyed.join(covered.withColumnRenamed("s", "_s").hint("merge"), "_s", "left_anti").drop("_s")
