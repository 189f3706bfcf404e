"""Bloom filters as numpy bits: built by Spark, broadcast, and tested in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter that only spares work: 8 MB, whatever the number of keys.
SPARING_BITS = 1 << 26


class Level:
    """One Bloom filter; keys come as two 64-bit hashes each."""

    def __init__(self, number: int, keys: int, rate: float, most_bits: int | None = None):
        self.number = number
        self.bits = max(64, 64 * math.ceil(-keys * math.log(rate) / math.log(2) ** 2 / 64))
        if most_bits is not None:
            self.bits = min(self.bits, most_bits)
        self.hashes = max(1, round(self.bits / max(keys, 1) * math.log(2))) if keys else 1
        self.hashes = min(self.hashes, 16)
        self.words = np.zeros(self.bits // 64, np.uint64)

    def places(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """hashes x keys: the bits of each key; a level's number enters, so that levels err independently."""
        step = (g ^ np.uint64((0x9E3779B97F4A7C15 * (2 * self.number + 1)) & (2**64 - 1))) | np.uint64(1)
        start = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(self.number)
        mixed = [start + np.uint64(i) * step for i in range(self.hashes)]
        return np.stack([(m ^ (m >> np.uint64(32))) % np.uint64(self.bits) for m in mixed])

    def passes(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        at = self.places(h, g)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def hash_pair(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(F.lit("g"), key)]


def filled(keys: DataFrame, level: Level) -> Level:
    """Sets the level's bits for keys (key, h, g); words are merged by bit_or, so at most bits / 64 rows return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = level.places(unsigned(batch.column(0)), unsigned(batch.column(1))).ravel()
            bit = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["word", "bit"])

    words = keys.select("h", "g").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bit"))
    for row in words.toLocalIterator():
        level.words[row["word"]] = np.int64(row["bit"]).view(np.uint64)
    return level


def suspected(rows: DataFrame, id_col: str, keys: DataFrame) -> Column | None:
    """Whether a Bloom filter of keys (one column, id_col), of at most SPARING_BITS, passes the row's key; None without keys."""
    n = keys.count()
    if not n:
        return None
    h, g = hash_pair(F.col(id_col))
    level = filled(keys.select(h.alias("h"), g.alias("g")), Level(0, n, 0.01, SPARING_BITS))
    shared = rows.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def suspect(h: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(shared.value.passes(h.to_numpy(np.int64).view(np.uint64), g.to_numpy(np.int64).view(np.uint64)))

    return F.col(id_col).isNotNull() & suspect(h, g)


def without(rows: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """rows without those whose id is in dropped (one column, id_col, without nulls); rows with a null id stay.

    A Bloom filter of the dropped ids, of at most SPARING_BITS, is broadcast: rows that it rejects are kept where they are,
    and only the others (the dropped ones and a few by error) go through the exact anti-join's shuffle. With more ids than
    the filter can tell apart more rows are shuffled; the result is the same."""
    ids = dropped.distinct()
    hit = suspected(rows, id_col, ids)
    if hit is None:
        return rows
    return rows.where(~hit).unionByName(rows.where(hit).join(ids, id_col, "left_anti"))


def once(rows: DataFrame, id_col: str, repeated: DataFrame) -> DataFrame:
    """rows with one row of each id; repeated (one column, id_col): the ids that occur more than once. Only rows that a
    Bloom filter of these passes are shuffled, after each task has merged its own."""
    hit = suspected(rows, id_col, repeated)
    if hit is None:
        return rows
    return rows.where(~hit).unionByName(rows.where(hit).dropDuplicates([id_col]))
