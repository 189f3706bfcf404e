"""Duplicate names: names of one label that contain each other or are near in spelling, without comparing all with all.

Equal names are one class first, whatever their number. Classes meet on keys of three kinds:

* deletions: names of up to DELETED characters, by what is left of them after up to `edits` characters are deleted. Two names
  within that edit distance have such a rest in common;
* segments: longer names are cut into edits + 1 segments, one of which the edits leave whole; a name of the same length or up to
  `edits` more probes with its own pieces at every place where such a segment can have moved;
* grams: a name that another contains is known by the rarest gram of the longest of GRAMS that it has; names are indexed by all of theirs.

Frequent keys are dealt in parts: index rows by name, probes to each part. Every pair that meets is then tested exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators.graph import apart, saved

#: Names of up to so many characters are indexed by deletions (about n^2 / 2 rests for two edits).
DELETED = 32
#: Lengths of grams; a contained name is known by the longest that fits it.
GRAMS = (12, 6, 3, 2, 1, 0)
#: Index rows of one key and part.
HOT = 1000


def shorter(name: Column) -> Column:
    """The name without one of its characters, each in turn."""
    places = F.when(F.length(name) > 0, F.sequence(F.lit(1), F.length(name))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))


def rests(name: Column, edits: int) -> Column:
    """What is left of a name after up to `edits` deletions."""
    level, out = F.array(name), F.array(name)
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.array_union(out, level)
    return out


def grams(name: Column, size: int) -> Column:
    """The distinct substrings of that many characters."""
    if size == 0:
        return F.array(F.lit(""))
    last = F.length(name) - size + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(name, i, F.lit(size))))


def _segment(length: Column, k: int, parts: int) -> tuple[Column, Column]:
    """(first place, length) of segment k of a name of that length."""
    size = F.floor(length / parts).cast("int")
    return size * k + 1, F.when(F.lit(k) < parts - 1, size).otherwise(length - size * (parts - 1))


def segments(name: Column, edits: int) -> Column:
    length = F.length(name)
    cut = [(k, *_segment(length, k, edits + 1)) for k in range(edits + 1)]
    return F.array(*[F.concat_ws("|", length.cast("string"), F.lit(str(k)), F.substr(name, a, n)) for k, a, n in cut])


def probes(name: Column, edits: int) -> Column:
    """The segments that a name of up to `edits` fewer characters, or as many, has in common with this one if no more edits lie between them."""
    out = []
    for fewer in range(edits + 1):
        length = F.length(name) - fewer
        for k in range(edits + 1):
            first, size = _segment(length, k, edits + 1)
            for shift in range(-edits, edits + 1):
                fits = (first + shift >= 1) & (first + shift + size - 1 <= F.length(name))
                out.append(F.when(fits, F.concat_ws("|", length.cast("string"), F.lit(str(k)), F.substr(name, first + shift, size))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def _pairs(asked: DataFrame, index: DataFrame, counts: DataFrame, fits: Column) -> DataFrame:
    """(label, name, other) that fit where asked and index, both (label, key, name), share a key; counts: the index rows (label, key, n) of each."""
    parts = F.ceil(F.col("n") / HOT).cast("int")
    sized = counts.select("label", "key", parts.alias("parts"))
    dealt = index.join(apart(sized), ["label", "key"]).select("label", "key", F.col("name").alias("other"), F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"))
    sent = asked.join(apart(sized), ["label", "key"]).select("label", "key", "name", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return sent.join(apart(dealt), ["label", "key", "part"]).where("name <> other").where(fits).select("label", "name", "other")


def _counted(index: DataFrame) -> DataFrame:
    return index.groupBy("label", "key").agg(F.count("*").alias("n"))


def spelt_alike(classes: DataFrame, edits: int) -> DataFrame:
    """(label, name, other): all pairs of classes (label, name) that are up to `edits` edits apart, in one direction at least; repeats stay."""
    keyed = lambda rows, keys: rows.select("label", F.explode(keys).alias("key"), "name")
    tasks, fits = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.levenshtein("name", "other", edits) >= 0
    short = classes.where(F.length("name") <= DELETED).repartition(tasks, "name")  # names are few, what is left of them is not
    near = saved(keyed(short, F.transform(rests(F.col("name"), edits), lambda x: F.xxhash64(x))))
    met = _pairs(near, near, saved(_counted(near).where("n > 1")), (F.col("name") < F.col("other")) & fits)
    long = classes.where(F.length("name") > DELETED - edits)
    cut = keyed(long, segments(F.col("name"), edits))
    return met.unionByName(_pairs(keyed(long, probes(F.col("name"), edits)), cut, _counted(cut), fits))


def near_names(names: DataFrame, edits: int) -> DataFrame:
    """(label, name, other, d) of the distinct names (label, name) that are up to `edits` edits apart, in both directions and each with itself."""
    classes = saved(names.select("label", "name").distinct())
    met = spelt_alike(classes, edits)
    met = met.unionByName(met.select("label", F.col("other").alias("name"), F.col("name").alias("other"))).distinct()
    near = met.withColumn("d", F.levenshtein("name", "other", edits)).where("d >= 0")
    return near.unionByName(classes.select("label", "name", F.col("name").alias("other"), F.lit(0).alias("d")))


def candidates(classes: DataFrame, edits: int) -> DataFrame:
    """(label, name, other) of classes (label, name) that are up to `edits` edits apart or contain each other, each pair in one direction at least."""
    keyed = lambda rows, keys: rows.select("label", F.explode(keys).alias("key"), "name")
    met = spelt_alike(classes, edits)
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = saved(keyed(classes.repartition(tasks, "name"), F.flatten(F.array(*[grams(F.col("name"), n) for n in GRAMS]))))
    counts = saved(_counted(every))
    own = F.lit(None).cast("array<string>")
    for size in reversed(GRAMS):
        own = F.when(F.length("name") >= size, grams(F.col("name"), size)).otherwise(own)
    rarest = keyed(classes, own).join(apart(counts), ["label", "key"]).groupBy("label", "name").agg(F.min(F.struct("n", "key")).alias("x"))
    asked = rarest.where("x.n > 1").select("label", "x.key", "name")
    return met.unionByName(_pairs(asked, every, counts.join(apart(asked.select("label", "key").distinct()), ["label", "key"], "left_semi"), F.contains("other", F.col("name"))))


def duplicate_groups(nodes: DataFrame, distance: int = 3, longer_than: int = 5) -> DataFrame:
    """(id, similar array): nodes of one label whose names contain each other or are, if longer than longer_than, under `distance` edits from
    another. Upper and lower case are alike; nodes without a label or name have no part."""
    folded = nodes.select("id", "label", F.lower("name").alias("name")).where("label IS NOT NULL AND name IS NOT NULL")
    sizes = saved(folded.groupBy("label", "name").agg(F.count("*").alias("n")))
    met = candidates(sizes.select("label", "name"), distance - 1)
    met = met.unionByName(met.select("label", F.col("other").alias("name"), F.col("name").alias("other"))).distinct()
    near = F.contains("name", F.col("other")) | F.contains("other", F.col("name")) | ((F.length("name") > longer_than) & (F.levenshtein("name", "other", distance - 1) >= 0))
    pairs = met.where(near).unionByName(sizes.where("n > 1").select("label", "name", F.col("name").alias("other")))
    ids = folded.select("label", F.col("name").alias("other"), F.col("id").alias("id2"))
    told = pairs.join(apart(ids), ["label", "other"]).groupBy("label", "name").agg(F.array_sort(F.collect_set("id2")).alias("all"))  # a list for each name
    own = folded.join(apart(told), ["label", "name"]).select("id", F.filter("all", lambda x: x != F.col("id")).alias("similar"))
    return own.where(F.size("similar") > 0)
