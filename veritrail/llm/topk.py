"""Exact top-k search by inner product on a pivot-distance index.

Vectors are rounded to integers and lifted by one component to a common norm, x' = (x, sqrt(M - |x|^2)) with M the
largest squared norm, which turns a greater inner product with q into a smaller distance from (q, 0). The index keys a
vector by its nearest pivot and its distance from it, and keeps vectors in that order in blocks: annuli around pivots.
A query's distance from the pivot bounds its distance from every vector of an annulus (triangle inequality). The query
first searches the annulus of the least bound, which gives k-th best distance r; it then visits the other annuli in order
of their bounds and stops at the first beyond its current r.

Pivots are drawn from a sample of at most SAMPLE vectors; every vector is indexed, and the bounds make the result exact
whatever the pivots. Queries are not collected: they are sent to the groups of blocks that their bounds leave, in batches,
and meet those blocks there. Groups hold about GROUP vectors each, cut by range with the id last, so that equal vectors
(however many) spread over groups; groups grow with the input up to LARGEST, as a query is sent once to each group that its
bounds leave. The directory of annuli (at most about DIRECTORY rows, as blocks grow with the input)
is broadcast.

Scores are exact: while the largest squared norm is under 2^53 all sums are exact in doubles, beyond that products are taken
in 64-bit integers. Vectors whose squared norm is 2^63 or more (FAR) are kept out of the index, whose distances they would blur; every query meets
them, and they as queries meet all vectors, in blocks, with products in integers of any size. A score that doesn't fit a long is the
long next to it.

Defined results for odd input: vectors that are null or hold null or non-finite components, or components that overflow a double once
scaled, and null ids, take no part;
vectors shorter than the longest are filled with zeros; a query's own row is every row of its id; a query id that occurs
more than once is asked once, with the least of its vectors; fewer candidates than k give fewer rows; ties of the score
go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.common import written

PIVOTS, SAMPLE, GROUP, LARGEST, BLOCK, DIRECTORY = 64, 4096, 8192, 65_536, 512, 100_000
_SLACK = 1e-6
_NONE = -(1 << 63)


def coded(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id long, v binary: the components floor(scale * x) as doubles, n their number, sq their squared norm, far: whether that is 2^63 or more)."""
    good = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = rows.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made, sizes, norms, far = [], [], [], [], []
            for k, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with np.errstate(over="ignore"):
                    x = np.floor(scale * np.asarray(values, np.float64))
                    sq = float(x @ x)
                if not np.isfinite(x).all():
                    continue
                far.append(sq >= 2.0**53 and (sq > 2.0**64 or sum(int(c) ** 2 for c in x) >= 1 << 63))
                ids.append(k), made.append(x.tobytes()), sizes.append(len(x)), norms.append(sq)
            columns = [pa.array(ids, pa.int64()), pa.array(made, pa.binary()), pa.array(sizes, pa.int32()), pa.array(norms, pa.float64()), pa.array(far, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "n", "sq", "far"])

    return picked.mapInArrow(run, "id long, v binary, n int, sq double, far boolean")


def chosen(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: the first row, then each time the row farthest from those chosen."""
    picks, gap = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picks) < min(count, len(sample)) and gap.max() > 0:
        picks.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[picks[-1]]) ** 2).sum(axis=1))
    return sample[picks]


class Space:
    """The lifted space: dimension, largest squared norm, pivots."""

    def __init__(self, size: int, top: float, sample: list[bytes]):
        self.size, self.top, self.wide = size, top, top >= 2.0**53
        self.pivots = chosen(self.lifted(self.rows(sample)), PIVOTS)

    def rows(self, values: list[bytes]) -> np.ndarray:
        out = np.zeros((len(values), self.size), np.int64)
        for k, v in enumerate(values):
            x = np.frombuffer(v, np.float64)
            out[k, : len(x)] = x
        return out

    def exact(self, x: np.ndarray) -> np.ndarray:
        """x in the numbers in which its products are exact."""
        return x if self.wide else x.astype(np.float64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(0, self.top - (x * x).sum(axis=1)))]

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum(0, (lifted**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * lifted @ p.T))


def index(vectors: DataFrame, space: Space, total: int) -> DataFrame:
    """A row for each block: grp, pivot, low, high (the annulus), ids, vs."""
    shared = vectors.sparkSession.sparkContext.broadcast(space)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space = shared.value
            d = space.distances(space.lifted(space.rows(batch.column(1).to_pylist())))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), batch.column(0), batch.column(1)], names=["pivot", "d", "id", "v"]
            )

    keyed = vectors.select("id", "v").mapInArrow(key, "pivot int, d double, id long, v binary")
    block, group = max(BLOCK, total // DIRECTORY), min(LARGEST, max(GROUP, total // 64))
    ordered = keyed.repartitionByRange(max(1, -(-total // max(group, block))), "pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, held = shared.value, []

        def flush():
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]]), pa.array([held[-1][1]]), pa.array([np.array([h[2] for h in held], np.int64).tobytes()], pa.binary()),
                 pa.array([space.rows([h[3] for h in held]).tobytes()], pa.binary())],
                names=["pivot", "low", "high", "ids", "vs"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != held[0][0] or len(held) >= block):
                    yield from flush()
                    held.clear()
                held.append(row)
        if held:
            yield from flush()

    packed = ordered.mapInArrow(pack, "pivot int, low double, high double, ids binary, vs binary")
    return written(packed.withColumn("grp", F.spark_partition_id()), "annuli")


class Best:
    """The k best (score, id) of some queries so far; reach: the distance beyond which nothing can enter."""

    def __init__(self, space: Space, x: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray):
        self.x, self.ids, self.k = space.exact(x), ids, k
        plain = x.astype(np.float64)
        self.sq = (plain * plain).sum(axis=1)
        self.top = space.top
        self.d = space.distances(np.c_[plain, np.zeros(len(x))])
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(x)
        self.floor = floor.copy()

    def reach(self) -> np.ndarray:
        """Of a score floor s: the distance sqrt(|q|^2 + M - 2 s); rounding is allowed for."""
        r = np.sqrt(np.maximum(0, self.sq + self.top - 2 * self.floor))
        return np.where(self.floor == _NONE, np.inf, r * (1 + _SLACK) + _SLACK * np.sqrt(self.sq + self.top))

    def bounds(self, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """queries x annuli: no vector of the annulus is nearer."""
        d = self.d[:, pivot]
        slack = _SLACK * np.sqrt(self.sq + self.top)[:, None]
        return np.maximum(0, np.maximum(low - d, d - high) - slack)

    def search(self, own: np.ndarray, ids: np.ndarray, vs: np.ndarray) -> None:
        scores = (self.x[own] @ vs.T).astype(np.int64)
        for k, q in enumerate(own):
            fits = (ids != self.ids[q]) & (scores[k] >= self.floor[q])
            s, i = np.r_[self.found[q][0], scores[k][fits]], np.r_[self.found[q][1], ids[fits]]
            if len(s) > self.k:
                edge = np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, i = s[s >= edge], i[s >= edge]
            order = np.lexsort((i, -s))[: self.k]
            self.found[q] = (s[order], i[order])
            if len(order) == self.k:
                self.floor[q] = max(self.floor[q], s[order][-1])

    def expand(self, blocks: list[tuple]) -> None:
        """Visits the annuli in order of their bounds, until the bounds of all queries are beyond their reach."""
        at = [np.array([b[k] for b in blocks]) for k in (0, 1, 2)]
        bounds = self.bounds(*at)
        for k in np.argsort(bounds.min(axis=0), kind="stable"):
            own = np.flatnonzero(bounds[:, k] <= self.reach())
            if len(own):
                self.search(own, blocks[k][3], blocks[k][4])


def _visit(annuli: DataFrame, routed: DataFrame, space, k: int, parts: int) -> DataFrame:
    """The k best of each routed query (grp, qid, q, floor) in its group: (qid, q, id, score)."""
    none = F.lit(None)
    left = annuli.select("grp", F.lit(0).alias("kind"), "pivot", "low", "high", none.cast("long").alias("floor"), none.cast("long").alias("qid"), "ids", "vs")
    right = routed.select("grp", F.lit(1).alias("kind"), none.cast("int").alias("pivot"), none.cast("double").alias("low"), none.cast("double").alias("high"), "floor", "qid",
                          none.cast("binary").alias("ids"), F.col("q").alias("vs"))
    both = left.unionByName(right).repartition(parts, "grp").sortWithinPartitions("grp", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, here, blocks, asked = space.value, None, [], []

        def answer():
            best = Best(own, own.rows([a[2] for a in asked]), np.array([a[0] for a in asked], np.int64), k, np.array([a[1] for a in asked], np.int64))
            best.expand(blocks)
            size = [len(s) for s, _ in best.found]
            at = np.repeat(np.arange(len(asked)), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.ids[at]), pa.array(np.concatenate([i for _, i in best.found])), pa.array(np.concatenate([s for s, _ in best.found]))],
                names=["qid", "id", "score"],
            )

        for batch in batches:
            for grp, kind, pivot, low, high, floor, qid, ids, vs in zip(*(c.to_pylist() for c in batch.columns)):
                if grp != here or len(asked) >= 512:
                    if asked and blocks:
                        yield from answer()
                    asked = []
                if grp != here:
                    here, blocks = grp, []
                if kind == 0:
                    i = np.frombuffer(ids, np.int64)
                    blocks.append((pivot, low, high, i, own.exact(np.frombuffer(vs, np.int64).reshape(len(i), -1))))
                else:
                    asked.append((qid, floor, vs))
        if asked and blocks:
            yield from answer()

    return both.mapInArrow(run, "qid long, id long, score long")


def _routed(queries: DataFrame, space, directory, near: bool) -> DataFrame:
    """(grp, qid, q, floor): near: to the group of the annulus of the least bound; else to all that the floor leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, pivot, low, high = directory.value
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                floor = part.column(2).to_numpy(zero_copy_only=False)
                best = Best(space.value, space.value.rows(part.column(1).to_pylist()), part.column(0).to_numpy(zero_copy_only=False), 1, floor)
                bounds, reach = best.bounds(pivot, low, high), best.reach()
                to, row = [], []
                for k in range(part.num_rows):
                    own = grp[[int(bounds[k].argmin())]] if near else np.unique(grp[bounds[k] <= reach[k]])
                    to.append(own)
                    row.append(np.full(len(own), k))
                part = part.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int32)), *part.columns], names=["grp", "qid", "q", "floor"])

    return queries.select("qid", "q", "floor").mapInArrow(run, "grp int, qid long, q binary, floor long")


def _blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """rows (id, v) as blocks (name: array of structs id, v) of at most `size` rows, each of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size).to_struct_array()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=[name])

    return rows.select("id", "v").mapInArrow(run, f"{name} array<struct<id:long,v:binary>>")


def _far(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, id, score) of the k best of each pair of blocks of queries and vectors (id, v), by integers of any size."""
    most, least = (1 << 63) - 1, -(1 << 63)

    def whole(row: dict) -> list[int]:
        return [int(c) for c in np.frombuffer(row["v"], np.float64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                others, out = [(r["id"], whole(r)) for r in given], []
                for q in asked:
                    x = whole(q)
                    scored = ((-min(most, max(least, sum(a * b for a, b in zip(x, y)))), i) for i, y in others if i != q["id"])
                    out += [(q["id"], i, -s) for s, i in nsmallest(k, scored)]
                columns = list(zip(*out)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["qid", "id", "score"])

    return _blocks(queries, "a", 256).crossJoin(_blocks(vectors, "b", 1024)).mapInArrow(run, "qid long, id long, score long")  # blocks of a stated set of queries


def _indexed(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(qid, id, score) of the k best of rows (id, v, n, sq) for asked (qid, q), by the index."""
    spark = rows.sparkSession
    total, size, top = rows.agg(F.count("*"), F.max("n"), F.max("sq")).first()
    if not total:
        return asked.where("false").select("qid", F.col("qid").alias("id"), F.col("qid").alias("score"))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "v").select("v").limit(SAMPLE).collect()]
    own = Space(size, top, sample)
    space = spark.sparkContext.broadcast(own)
    annuli = index(rows, own, total)
    entries = annuli.select("grp", "pivot", "low", "high").collect()  # at most about DIRECTORY rows and one a group and pivot
    columns = list(zip(*entries))
    directory = spark.sparkContext.broadcast((np.array(columns[0], np.int32), np.array(columns[1], np.int32), np.array(columns[2]), np.array(columns[3])))
    parts = len(set(columns[0]))
    first = _visit(annuli, _routed(asked.withColumn("floor", F.lit(_NONE)), space, directory, True), space, k, parts)
    floors = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    seeded = asked.join(floors, "qid", "left").select("qid", "q", F.coalesce("floor", F.lit(_NONE)).alias("floor"))
    return _visit(annuli, _routed(seeded, space, directory, False), space, k, parts)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank from 1, id_col, score) of the k greatest inner products of each query with the other rows.

    is_query: a predicate on the column `id`, the row's id as long, that says which rows are queries too."""
    rows = written(coded(vectors, id_col, vector_col, scale), "vectors")
    asked = rows.where(is_query).groupBy(F.col("id").alias("qid")).agg(F.min(F.struct("v", "far")).alias("x"))
    asked = written(asked.select("qid", F.col("x.v").alias("q"), F.col("x.far").alias("far")), "queries")
    near, far = rows.where("NOT far"), rows.where("far")
    found = _indexed(near, asked.where("NOT far").select("qid", "q"), k)
    if far.limit(1).count():
        vector = lambda frame: frame.select(F.col("qid").alias("id"), F.col("q").alias("v"))
        found = found.unionByName(_far(vector(asked), far, k)).unionByName(_far(vector(asked.where("far")), near, k))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
