"""URL filters by a Bloom filter cascade.

A cascade holds a list of keys exactly, relative to a complete universe of keys that will ever be asked: level 0 is a
Bloom filter of the listed keys, level 1 one of the universe's keys that level 0 lets through wrongly, level 2 one of
the listed keys that level 1 lets through wrongly, and so on until a level makes no error. A key is listed if the first
level that rejects it is odd (or none does and the last level is even). The levels are a few bits a listed key, so the
judged rows meet no join and no shuffle.

A rule is a host and a path prefix and fits the host and all its subdomains. The keys asked of a url are its host's
suffixes, as many labels long as some rule's host, each with the prefixes of its path that are as long as some rule's
path. The universe is every such key of the corpus. The block rules are one cascade, the allow rules another; of the
keys found in either, the longest decides (ties: the greater string), and a url without one gets the default verdict.

Filters are broadcast, so their size is checked: a list of over MAX_LISTED keys (8 MB of filter a list) is matched by
exact joins on the keys instead.

Defined results for odd input: a null url, or one without `://`, has an empty host and path, which no rule fits; repeated
rows are judged each; an empty table or an empty rule list is allowed; columns other than the id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.bloom import Level, filled, unsigned
from veritrail.llm.common import written

MAX_LISTED = 4_000_000
RATE = 0.01
MAX_LEVELS = 40
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def member(levels: Sequence[Level], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which keys the cascade lists."""
    found, alive = np.zeros(len(h), bool), np.arange(len(h))
    for level in levels:
        inside = level.passes(h[alive], g[alive])
        found[alive[~inside]] = level.number % 2 == 1
        alive = alive[inside]
    found[alive] = bool(levels) and levels[-1].number % 2 == 0
    return found


def _through(keys: DataFrame, levels: Sequence[Level]) -> DataFrame:
    """Those rows (key, h, g) that all the levels let through."""
    shared = keys.sparkSession.sparkContext.broadcast(list(levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, g = unsigned(batch.column(1)), unsigned(batch.column(2))
            inside = np.ones(len(h), bool)
            for level in shared.value:
                inside &= level.passes(h, g)
            yield batch.filter(pa.array(inside))

    return keys.mapInArrow(run, keys.schema)


def cascade(listed: DataFrame, universe: DataFrame, rate: float = RATE) -> list[Level]:
    """The levels for listed (key) over universe (key); both may repeat keys. At most MAX_LISTED keys may be listed."""
    hashed = lambda df: df.select("key", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("g"), "key").alias("g"))
    own = hashed(listed.select("key").where("key is not null").distinct())
    inside, n = own, own.count()
    if n > MAX_LISTED:
        raise ValueError(f"{n} keys are listed; a broadcast cascade takes {MAX_LISTED}")
    if not n:
        return []
    levels = [filled(inside, Level(0, n, rate))]
    # distinct before the join, so that a key that many rows ask is merged before it is shuffled
    wrong = _through(hashed(universe.where("key is not null")), levels).distinct().join(own.select("key"), "key", "left_anti")
    outside = written(wrong.select("key", "h", "g"), "cascade")
    while len(levels) < MAX_LEVELS:
        n = outside.count()
        if not n:
            return levels
        levels.append(filled(outside, Level(len(levels), n, rate)))
        inside, outside = outside, _through(inside, levels[-1:])
    raise RuntimeError("two keys share both hashes")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The keys asked of a url: bounded by (label counts in rules) x (path lengths in rules)."""
    labels = sorted({h.count(".") + 1 for h, _ in rules})
    lengths = sorted({len(p) for _, p in rules})
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    made = [
        F.when((dots >= n - 1) & (host != "") & (F.length(path) >= size), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)))
        for n in labels
        for size in lengths
    ]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


def judge(
    pages: DataFrame, block: Sequence[tuple[str, str]], allow: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """id_col, host, path, rule, verdict for each row. A rule is (host in lower case, path)."""
    spark = pages.sparkSession
    both = [*block, *allow]
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    asked = parsed.withColumn("keys", keys_of(F.col("host"), F.col("path"), both))
    universe = asked.select(F.explode("keys").alias("key"))
    lists = [[h + p for h, p in rules] for rules in (block, allow)]
    listed = [spark.createDataFrame([(k,) for k in keys], "key string") for keys in lists]
    if max(map(len, lists)) > MAX_LISTED:
        found = _joined(asked, listed)
    else:
        found = _probed(asked, [cascade(x, universe) for x in listed])
    best = F.array_max(F.transform(
        F.filter(F.arrays_zip("keys", "found"), lambda x: x["found"] > 0),
        lambda x: F.struct(F.length(x["keys"]).alias("size"), x["keys"].alias("rule"), x["found"].alias("found")),
    ))
    picked = found.select("id", "host", "path", best.alias("best"))
    verdict = F.when(F.col("best.found") == 1, "block").when(F.col("best.found") == 2, "allow").otherwise(default)
    return picked.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def _probed(asked: DataFrame, cascades: list[list[Level]]) -> DataFrame:
    """asked with `found`: for each key 1 if the first cascade lists it, else 2 if the second does, else 0."""
    shared = asked.sparkSession.sparkContext.broadcast(cascades)
    hashed = asked.withColumns({"h": F.transform("keys", lambda k: F.xxhash64(k)), "g": F.transform("keys", lambda k: F.xxhash64(F.lit("g"), k))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("h"))
            h, g = unsigned(lists.flatten()), unsigned(batch.column(batch.schema.get_field_index("g")).flatten())
            found = np.zeros(len(h), np.int32)
            for number, levels in reversed(list(enumerate(shared.value, 1))):
                found[member(levels, h, g)] = number
            offsets = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
            column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], column], names=[*batch.schema.names[:4], "found"])

    id_type = asked.schema["id"].dataType.simpleString()
    return hashed.mapInArrow(run, f"id {id_type}, host string, path string, keys array<string>, found array<int>")


def _joined(asked: DataFrame, listed: list[DataFrame]) -> DataFrame:
    """The same as _probed by joins on the keys, for lists too long to broadcast."""
    numbered = written(asked.withColumn("row", F.monotonically_increasing_id()), "asked")
    marks = listed[0].withColumn("n", F.lit(1)).unionByName(listed[1].withColumn("n", F.lit(2))).groupBy("key").agg(F.min("n").alias("n"))
    hits = numbered.select("row", F.explode("keys").alias("key")).join(marks, "key").groupBy("row").agg(
        F.map_from_entries(F.collect_set(F.struct("key", "n"))).alias("hits")
    )
    joined = numbered.join(hits, "row", "left")
    found = F.transform("keys", lambda k: F.coalesce(F.try_element_at("hits", k), F.lit(0)))
    return joined.select("id", "host", "path", "keys", found.alias("found"))
