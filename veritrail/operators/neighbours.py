"""All k nearest neighbours by cosine, exactly, on annuli around pivots.

Vectors are made unit vectors, so that a greater cosine is a smaller distance. Each is keyed by its nearest pivot and its
distance from it, and vectors are kept in that order in blocks: a block is an annulus around a pivot. Queries are kept in blocks
of the same kind. A block of queries first meets one block of vectors, the one around its pivot that is nearest in distance
(in a self-join its own), which gives each query the cosine of its k-th best so far. By the triangle inequality a vector whose distance from
a pivot differs from the query's by more than the k-th best distance can't be among the k nearest; so each block of queries has
an interval of distances around every pivot, and meets the blocks of vectors whose annuli reach into it, by a join on the
pivot. Only pairs that beat the k-th best so far leave a task.

Blocks meet in tiles, a strip of blocks of queries by a strip of blocks of vectors: a task gets each block of its tile once, and multiplies
those pairs of them that are to meet. A block is sent to one tile in each strip of the other side, not to each block that it meets. Strips
grow with the tables up to TILE blocks, so what is shuffled grows as the tables do up to STRIPS x TILE blocks, and then as their product over TILE.

The result doesn't depend on the pivots; how many blocks meet does. Where distances concentrate (many dimensions, no
clusters) the intervals spare little, and work is that of all pairs of blocks that are left.

Vectors that are null or hold null or non-finite components, and null ids, take no part; a vector of zeros has cosine 0 with all; repeated
ids are rows of their own; ties go to the smaller id; fewer vectors than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.operators.graph import saved

PIVOTS, SAMPLE, BLOCK = 64, 4096, 1024
#: Strips that a side is cut into, as long as none has more than TILE blocks.
STRIPS, TILE = 16, 64
#: Rounding of cosines, so that they don't depend on how blocks are cut; and room for errors of distances.
DECIMALS, SLACK = 12, 1e-6


def chosen(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: the first, then each time the row farthest from those chosen."""
    if not len(sample):
        return sample
    picked, gap = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(picked) < min(count, len(sample)) and gap.max() > SLACK:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    return sample[picked]


def units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def lifted(rows: np.ndarray, side: int) -> np.ndarray:
    """Unit vectors with two more components, in which vectors of zeros are unit vectors too, at right angles to all of the other side."""
    out = np.zeros((len(rows), rows.shape[1] + 2))
    out[:, :-2] = rows
    out[~rows.any(axis=1), side - 2] = 1
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def _matrix(data: bytes, n: int, kind: type) -> np.ndarray:
    """The unit vectors of a block, which is kept as it was given."""
    return units(np.frombuffer(data, kind).reshape(n, -1).astype(np.float64))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def kept_as(rows: DataFrame, vector_col: str) -> type:
    return np.float32 if rows.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64


def packed(rows: DataFrame, pivots: np.ndarray, side: int, block: int, kind: type) -> DataFrame:
    """(no, pivot, low, high, ids, m) for each block of usable rows, written."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                given = np.array(batch.column(1).to_pylist(), np.float64)
                d = distances(lifted(units(given), side), shared.value)
                near = d.argmin(axis=1)
                vectors = pa.array([x.tobytes() for x in given.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), batch.column(0), vectors], names=["pivot", "d", "id", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(pivot))):
                for at in range(a, b, block):
                    to = min(at + block, b)
                    ids, m = np.asarray(batch.column(2))[at:to].tobytes(), b"".join(batch.column(3).slice(at, to - at).to_pylist())
                    yield pa.RecordBatch.from_pydict({"pivot": pivot[at : at + 1], "low": [d[at]], "high": [d[to - 1]], "ids": [ids], "m": [m]})

    keyed = rows.mapInArrow(key, "pivot int, d double, id long, v binary").repartitionByRange("pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")
    return saved(keyed.mapInArrow(pack, "pivot int, low double, high double, ids binary, m binary").withColumn("no", F.monotonically_increasing_id()))


def stripped(blocks: DataFrame, strips: int, most: int) -> DataFrame:
    """(no, strip): blocks in the order of their numbers, in so many strips, or more of `most` blocks each."""
    part = F.shiftright("no", 33)
    sizes = blocks.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each task that wrote blocks
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    size = F.least(F.lit(most), F.ceil(F.sum("n").over(Window.partitionBy(F.lit(0))) / strips))
    starts = sizes.select("part", before.alias("before"), size.alias("size"))
    place = F.col("before") + F.col("no").bitwiseAND((1 << 33) - 1)
    return blocks.select("no", part.alias("part")).join(F.broadcast(starts), "part").select("no", F.floor(place / F.col("size")).alias("strip"))


def best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, ids) of the k nearest rows of v for each row of q."""
    s = np.round(q @ v.T, DECIMALS) + 0.0
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s))[:, :k]
    return np.take_along_axis(s, order, axis=1), ids[order]


def kept_best(row: np.ndarray, cosine: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, cosine, id) the k best of each row, and the floor of each row raised to its k-th."""
    order = np.lexsort((ids, -cosine, row))
    row, cosine, ids = row[order], cosine[order], ids[order]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    floor = floor.copy()
    last = place == k - 1
    floor[row[last]] = np.maximum(floor[row[last]], cosine[last])
    good = place < k
    return row[good], cosine[good], ids[good], floor


class AllNearest:
    """`found` (query_id, id, cosine): the k nearest of each query; `report` (query_blocks, vector_blocks, met): how many pairs of blocks met."""

    def __init__(self, queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vector_col: str, block: int = BLOCK, pivots: int = PIVOTS):
        asked, given = usable(queries, id_col, vector_col), usable(vectors, id_col, vector_col)
        some = given.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
        sample = lifted(units(np.array(some, np.float64)), 0) if some else np.zeros((0, 2))
        self.k, self.pivots = k, chosen(sample, pivots)
        self.shared = queries.sparkSession.sparkContext.broadcast(self.pivots)
        if not some:
            self.found = asked.where("false").select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("cosine"))
            self.report = asked.limit(0).agg(*[F.count("*").alias(c) for c in ("query_blocks", "vector_blocks", "met")])
            return
        self.q_kind, self.v_kind = kept_as(queries, vector_col), kept_as(vectors, vector_col)
        v = packed(given, self.pivots, 0, block, self.v_kind)
        q = packed(asked, self.pivots, 1, block, self.q_kind)
        self.q_strips, self.v_strips = saved(stripped(q, STRIPS, TILE)), saved(stripped(v, STRIPS, TILE))
        ring = [F.col(c) for c in ("no", "pivot", "low", "high")]
        q_ring, v_ring = q.select(*[c.alias(f"q_{n}") for c, n in zip(ring, ("no", "pivot", "low", "high"))]), v.select(*[c.alias(f"v_{n}") for c, n in zip(ring, ("no", "pivot", "low", "high"))])
        apart = F.abs(F.col("q_low") + F.col("q_high") - F.col("v_low") - F.col("v_high"))
        near = q_ring.join(v_ring, F.col("q_pivot") == F.col("v_pivot")).groupBy("q_no").agg(F.min_by("v_no", F.struct(apart, "v_no")).alias("v_no"))
        first = saved(q_ring.select("q_no").join(near, "q_no", "left"))  # blocks of queries around a pivot without vectors meet none yet
        seen = saved(self._met(first, q, v, None))
        reach = seen.where("pivot IS NOT NULL").select(F.col("no").alias("q_no"), "pivot", "low", "high")
        pairs = reach.join(v_ring, (F.col("pivot") == F.col("v_pivot")) & (F.col("v_high") >= F.col("low")) & (F.col("v_low") <= F.col("high"))).select("q_no", "v_no").distinct()
        second = saved(pairs.join(first.where("v_no IS NOT NULL"), ["q_no", "v_no"], "left_anti"))
        least = seen.where("least IS NOT NULL").select("no", "least")
        more = self._met(second, q, v, least)
        every = seen.where("query_id IS NOT NULL").select("query_id", "id", "cosine").unionByName(more.select("query_id", "id", "cosine"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
        self.found = every.withColumn("place", place).where(F.col("place") <= k).drop("place")
        count = lambda df, name: df.agg(F.count("*").alias(name))
        met = first.where("v_no IS NOT NULL").unionByName(second)
        self.report = count(q_ring, "query_blocks").crossJoin(count(v_ring, "vector_blocks")).crossJoin(count(met, "met"))  # one row each

    def _met(self, pairs: DataFrame, q: DataFrame, v: DataFrame, least: DataFrame | None) -> DataFrame:
        """Rows of three kinds: (query_id, id, cosine) of the k best of each query; and, in the first step (least is None), for each block of queries (no, pivot,
        low, high) the interval around each pivot, and (no, least) the cosines to beat."""
        k, shared, q_kind, v_kind = self.k, self.shared, self.q_kind, self.v_kind
        of = lambda strips, side: strips.select(F.col("no").alias(f"{side}_no"), F.col("strip").alias(f"{side}_strip"))
        placed = pairs.join(of(self.q_strips, "q"), "q_no").join(of(self.v_strips, "v"), "v_no", "left").withColumn("v_strip", F.coalesce("v_strip", F.lit(-1)))
        meets = placed.groupBy("q_strip", "v_strip", "q_no").agg(F.collect_list("v_no").alias("v_nos"))  # at most a strip
        one = q.select(F.col("no").alias("q_no"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
        other = v.select(F.col("no").alias("v_no"), F.col("ids").alias("v_ids"), F.col("m").alias("v_m"))
        if least is not None:
            one = one.join(least.select(F.col("no").alias("q_no"), "least"), "q_no")
        else:
            one = one.withColumn("least", F.lit(None).cast("binary"))
        asked = meets.join(one, "q_no").select("q_strip", "v_strip", "q_no", "q_ids", "q_m", "least", "v_nos")
        met = placed.where("v_no IS NOT NULL").select("q_strip", "v_strip", "v_no").distinct().join(other, "v_no").select(F.col("q_strip").alias("to_q"), F.col("v_strip").alias("to_v"), "v_no", "v_ids", "v_m")
        fields = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64()), ("no", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("least", pa.binary())])

        def made(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            blocks = {}
            for no, v_ids, v_m in zip(*(right.column(c).to_pylist() for c in ("v_no", "v_ids", "v_m"))):
                others = np.frombuffer(v_ids, np.int64)
                blocks[no] = others, _matrix(v_m, len(others), v_kind)
            out = []
            for no, q_ids, q_m, bound, v_nos in zip(*(left.column(c).to_pylist() for c in ("q_no", "q_ids", "q_m", "least", "v_nos"))):
                ids = np.frombuffer(q_ids, np.int64)
                m = _matrix(q_m, len(ids), q_kind)
                floor = np.full(len(ids), -np.inf) if bound is None else np.frombuffer(bound, np.float64)
                hits = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
                for v_no in sorted(v_nos):
                    others, vectors = blocks[v_no]
                    if np.isneginf(floor).any():
                        s, found = best(m, vectors, others, k)
                        row, at = np.nonzero(s >= floor[:, None])
                        more = row, s[row, at], found[row, at]
                    else:
                        s = m @ vectors.T
                        row, at = np.nonzero(s >= floor[:, None] - SLACK)
                        s = np.round(s[row, at], DECIMALS) + 0.0
                        good = s >= floor[row]
                        more = row[good], s[good], others[at[good]]
                    *hits, floor = kept_best(*(np.concatenate(x) for x in zip(hits, more)), k, floor)
                out.append(made(query_id=ids[hits[0]], id=hits[2], cosine=hits[1]))
                if bound is None:
                    reach = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(floor, -1))) + SLACK
                    d = distances(lifted(m, 1), shared.value)
                    out.append(made(no=[no] * d.shape[1], pivot=np.arange(d.shape[1]), low=(d - reach[:, None]).min(axis=0), high=(d + reach[:, None]).max(axis=0)))
                    out.append(made(no=[no], least=[np.ascontiguousarray(floor).tobytes()]))
            return pa.Table.from_batches(out, fields)

        tiles = asked.groupBy("q_strip", "v_strip").cogroup(met.groupBy("to_q", "to_v"))
        return tiles.applyInArrow(run, "query_id long, id long, cosine double, no long, pivot int, low double, high double, least binary")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vector_col: str, block: int = BLOCK) -> DataFrame:
    """(query_id, id, cosine): the k nearest of every query vector."""
    return AllNearest(queries, vectors, k, id_col, vector_col, block).found
