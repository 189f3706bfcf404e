"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents each get target / size copies, a number from 0 to the cap, in general fractional. The whole part is
taken as it is. The fractions are rounded in pairs: words (fraction x size) move from one document of a pair to the
other, by chance in either direction so that each fraction keeps its mean, until one fraction is 0 or 1. The words
taken from the source don't change in a step, so a source misses its target by less than one document, whatever the
number of documents.

Pairing runs as a reduction tree. Leaves are blocks of about BLOCK documents of one source, told by a hash, so that a hot
source has more blocks, not larger ones. A block leaves at most one fraction; FAN_IN such residuals of a source form a
group of the next level. Each source's first block meets the residuals of the others in the last group, and the one that
is left there is rounded by chance. Chance is drawn from the seed and the group, so reruns agree.

Rows that are equal in every column are merged before the tree: n of them with fraction f, paired with each other, are
floor(n f) taken ones and one of the fraction that is left. Rows are told apart by two 64-bit hashes of all columns, in
which nulls count.

Targets: sources in code point order (null last) weigh `weights` in turn and share all words; a target stops at `cap`
times its source's size and the excess is shared by weight among the others until none is above. That is the level at
which min(cap * size, level * weight) adds up to all words, found by one sort of the sources.

Defined results for odd input: null text has size 0, and documents of size 0 take 0 words and one copy; null sources are
a source; null ids and repeated rows are documents of their own; very long texts are counted whole and paired like others;
ties of size are ordered by the row's hash; a table without words has targets 0; an empty table gives an empty result;
other columns tell rows apart and are handed on by `taken_documents`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm import bloom
from veritrail.llm.common import SPACE, row_hashes, written

WEIGHTS, CAP, BLOCK, FAN_IN, SEED, CHUNK = (5, 2, 1), 3, 256, 16, 20240607, 1000
_EDGE = 1e-9


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes: source, source_size, documents; adds weight and target. One row for each source, so one window holds it."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    weighed = sizes.withColumn("weight", weight.cast("double"))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    earlier, later = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    leveled = weighed.withColumns({"level": left / F.sum("weight").over(later), "nth": F.row_number().over(by_room)})
    free = F.col("level") * F.col("weight") <= cap * F.col("source_size")
    final = F.min_by(F.col("level"), F.when(free, F.col("nth"))).over(everything)
    return leveled.withColumn("target", F.least(cap * F.col("source_size").cast("double"), final * F.col("weight"))).drop("level", "nth")


def paired(size: np.ndarray, part: np.ndarray, chance: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds fractions by pairs, in the order given; returns them and the place of the one left (-1: none)."""
    part, held = part.copy(), -1
    part[part < _EDGE] = 0
    part[part > 1 - _EDGE] = 1
    for k in range(len(part)):
        if not 0 < part[k] < 1:
            continue
        if held < 0:
            held = k
            continue
        up = min((1 - part[held]) * size[held], part[k] * size[k])  # words that may move from k to held
        down = min(part[held] * size[held], (1 - part[k]) * size[k])
        moved = up if chance.random() * (up + down) < down else -down
        part[held] += moved / size[held]
        part[k] -= moved / size[k]
        for j in (held, k):
            if part[j] < _EDGE:
                part[j] = 0
            elif part[j] > 1 - _EDGE:
                part[j] = 1
        held = next((j for j in (held, k) if 0 < part[j] < 1), -1)
    return part, held


def _generator(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "big"))


def _rounder(level: int, last: bool, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "g", "h"], ascending=[False, True, True], kind="stable")
        source, block = rows["source"].iloc[0], int(rows["block"].iloc[0])
        chance = _generator(seed, level, None if pd.isna(source) else source, block)
        part, held = paired(rows["size"].to_numpy(np.float64), rows["part"].to_numpy(np.float64), chance)
        if last and held >= 0:
            part[held] = float(chance.random() < part[held])
            held = -1
        done = np.ones(len(rows), bool)
        if held >= 0:
            done[held] = False
        return rows.assign(part=part, done=done)

    return run


def _groups(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...], cap: float, seed: int) -> DataFrame:
    """A row for each group of equal rows of docs: g, h (a hash of all columns), n (how many), id, source, size,
    source_size, target, copies (of all n together)."""
    g, h = row_hashes(docs)
    picked = docs.select(g.alias("g"), h.alias("h"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = written(picked.groupBy("g", "h").agg(F.first("id").alias("id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("n")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("documents"))
    goal = written(targets(sizes, weights, cap), "targets")
    most = goal.agg(F.max("documents")).first()[0] or 0
    blocks = F.ceil(F.col("documents") / BLOCK).cast("long")
    goal_of = goal.select(F.col("source").alias("of"), "source_size", "target", blocks.alias("blocks"))
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = rows.join(goal_of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # n equal documents of fraction f, paired with each other, are floor(n f) taken ones and one of the fraction left
    known = known.withColumn("want", F.when(F.col("size") > 0, want * F.col("n")).otherwise(F.col("n").cast("double")))
    whole = F.floor(F.col("want") + F.lit(_EDGE) * F.greatest(F.lit(1.0), F.col("want"))).cast("long")
    start = written(known.withColumn("whole", whole).select(
        "g", "h", "n", "id", "source", "size", "source_size", "target", "whole", F.greatest(F.lit(0.0), F.col("want") - F.col("whole")).alias("part"),
        F.pmod(F.xxhash64("g", "h", F.lit(seed)), "blocks").alias("block"), "blocks",
    ), "start")
    items = start.where("part > 0").select("g", "h", "source", "size", "part", "block", "blocks")
    schema = items.schema.add("done", "boolean")
    levels, groups = 1, math.ceil(most / BLOCK)
    while groups > 1:
        groups = math.ceil(groups / FAN_IN)
        levels += 1
    # the first of a source's blocks meets the others' residuals last: the one left then is one of its small documents
    late = items.where("block = 0") if levels > 1 else items.where("false")
    now, parts = items.where("block > 0") if levels > 1 else items, []
    for level in range(levels):
        last = level == levels - 1
        if last:
            now = now.unionByName(late)
        now = written(now.groupBy("source", "block").applyInPandas(_rounder(level, last, seed), schema), f"level{level}")
        parts.append(now.where("done").select("g", "h", F.round("part").cast("long").alias("up")))
        now = now.where("not done").drop("done").withColumn("block", F.floor(F.col("block") / FAN_IN))
    rounded = parts[0]
    for part in parts[1:]:
        rounded = rounded.unionByName(part)
    copies = F.col("whole") + F.coalesce("up", F.lit(0))
    return start.join(rounded, ["g", "h"], "left").select("g", "h", "n", "id", "source", "size", "source_size", "target", copies.alias("copies"))


def _repeated(rows: DataFrame, times: str, name: str, most: int) -> DataFrame:
    """rows, each as often as its column times (at most `most`) says, numbered from 0 by name. A row of over CHUNK
    repetitions is first dealt in chunks, so that no task makes all of them."""
    few = rows.where(F.col(times).between(1, CHUNK)).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    if most <= CHUNK:
        return few
    many = rows.where(F.col(times) > CHUNK)
    low, high = F.col("_vt_low"), F.least(F.col("_vt_low") + CHUNK, F.col(times)) - 1
    dealt = many.withColumn("_vt_low", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(CHUNK).cast("long"))))
    dealt = dealt.repartition(F.xxhash64("_vt_low")).withColumn(name, F.explode(F.sequence(low, high))).drop("_vt_low")
    return few.unionByName(dealt)


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """id, g, h (hashes of the row), source, size, source_size, target, copies, taken for each row of docs."""
    groups = written(_groups(docs, id_col, source_col, text_col, weights, cap, seed), "groups")
    rows = _repeated(groups, "n", "nth", groups.agg(F.max("n")).first()[0] or 0)
    own = (F.floor(F.col("copies") / F.col("n")) + (F.col("nth") < F.col("copies") % F.col("n")).cast("long")).cast("int")
    return rows.withColumn("own", own).select("id", "g", "h", "source", "size", "source_size", "target", F.col("own").alias("copies"), (F.col("own") * F.col("size")).alias("taken"))


def taken_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken, with their own columns."""
    groups = written(_groups(docs, id_col, source_col, text_col, weights, cap, seed), "groups")
    g, h = row_hashes(docs)
    key = F.struct(g.alias("g"), h.alias("h"))
    repeated = groups.where("n > 1").select(F.struct("g", "h").alias("_vt_key"))
    single = bloom.once(docs.withColumn("_vt_key", key), "_vt_key", repeated)
    taken = groups.where("copies > 0").select(F.struct("g", "h").alias("_vt_key"), F.col("copies").alias("_vt_copies"))
    most = taken.agg(F.max("_vt_copies")).first()[0] or 0
    return _repeated(single.join(taken, "_vt_key"), "_vt_copies", "_vt_nth", most).select(*[F.col(f"`{c}`") for c in docs.columns])
