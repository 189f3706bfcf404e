"""Property-graph operators on two tables: nodes (id, label, ...) and edges (src, rel, dst)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Pairs that one task counts; nodes of one list up to which its pairs are made where it is.
DEALT, LISTED = 4_000_000, 1000
#: Nodes up to which a column of them is sent to all tasks.
NUMBERED = 1_000_000


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="veritrail-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one in local mode if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_own_folder()}"


def saved(df: DataFrame) -> DataFrame:
    """df written once to the folder in spark.checkpoint.dir and read back, so that its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df, marked for its next join to shuffle both sides: rows that were exploded or compress well are more than Spark takes them for when it
    chooses what to broadcast."""
    return df.hint("merge")


# ---- patterns -----------------------------------------------------------------------------------------------------


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, rel, b) for each edge in either direction."""
    return edges.select(F.col("src").alias("a"), "rel", F.col("dst").alias("b")).union(edges.select("dst", "rel", "src"))


def labelled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with src_label and dst_label; edges without both ends are dropped."""
    ends = nodes.select("id", "label")
    out = edges.join(ends.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src")
    return out.join(ends.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst").select("src", "rel", "dst", "src_label", "dst_label")


def schema_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_label, rel, dst_label): the distinct ones of `labelled_edges`. Edges that have repeats may be given; they are made distinct by their
    source's label before they meet their other end."""
    ends = nodes.select("id", "label")
    begins = edges.join(ends.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").select("src_label", "rel", "dst").distinct()
    return begins.join(ends.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst").select("src_label", "rel", "dst_label").distinct()


def allowed_triples(labelled: DataFrame, triples: Sequence[tuple[str, str, str]]) -> DataFrame:
    spark = labelled.sparkSession
    allowed = spark.createDataFrame(list(triples), "src_label string, rel string, dst_label string")
    return labelled.join(F.broadcast(allowed), ["src_label", "rel", "dst_label"], "left_semi")  # the schema's triples: a fixed few


def scrubbed_nodes(raw: DataFrame) -> DataFrame:
    """Back ticks and outer blanks out of id and type; rows that leave one of them empty go."""
    clean = lambda c: F.trim(F.replace(F.col(c), F.lit("`"), F.lit("")))
    return raw.select(clean("id").alias("id"), clean("type").alias("type")).where("id <> '' and type <> ''")


def unconnected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a neighbour among nodes."""
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(both_ways(inside).select(F.col("a").alias("id")).distinct(), "id", "left_anti")


def neighbours(edges: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(a, rel, b) of one hop, either direction, from the ids given."""
    return both_ways(edges.where(F.col("src").isin(list(ids)) | F.col("dst").isin(list(ids)))).where(F.col("a").isin(list(ids))).distinct()


def reachable(start: DataFrame, edges: DataFrame, hops: int, least: int = 1) -> DataFrame:
    """(origin, id) of nodes that paths of least to hops directed edges reach. start: one column, id. Steps are unrolled; the table of
    steps and each frontier, made distinct, are written once. The last frontier is made distinct with the result alone."""
    step = saved(edges.select("src", "dst").distinct())
    frontier, out = start.select(F.col("id").alias("origin"), "id").distinct(), None
    for k in range(1, hops + 1):
        frontier = frontier.join(step, F.col("id") == F.col("src")).select("origin", F.col("dst").alias("id"))
        if k < hops:
            frontier = saved(frontier.distinct())
        if k >= least:
            out = frontier if out is None else out.union(frontier)
    return out.distinct()


def shared_neighbours(links: DataFrame) -> DataFrame:
    """(a, b, shared), a < b: how many neighbours (met) two nodes (id) of links share. Lists of neighbouring nodes lie together, in as many tasks as their
    pairs ask, and pairs are counted there before they are shuffled: nodes that meet often mostly do so at near places. Longer lists
    than LISTED are joined instead."""
    own = saved(links.where("id IS NOT NULL AND met IS NOT NULL").distinct())
    n = F.count("*")
    sizes = own.groupBy("met").agg(n.alias("n"))
    pairs, most = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0))).first()
    few, many = own, None
    if most > LISTED:
        hot = saved(sizes.where(F.col("n") > LISTED).select("met"))
        few, long = own.join(hot, "met", "left_anti"), own.join(hot, "met", "left_semi")
        many = long.select(F.col("id").alias("a"), "met").join(apart(long.select(F.col("id").alias("b"), "met")), "met").where("a < b").select("a", "b")
    lists = few.repartitionByRange(int(pairs // DEALT) + 1, "met").groupBy("met").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    starts = lists.select("ids", F.posexplode("ids").alias("at", "a"))
    met = starts.select("a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("b"))
    return (met if many is None else met.union(many)).groupBy("a", "b").agg(n.alias("shared"))


def tree_closure(parents: DataFrame, depth: int) -> DataFrame:
    """(child, ancestor, distance) on an acyclic parent table (child, parent) of at most `depth` levels."""
    now = parents.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out, up = now, parents.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
    for k in range(2, depth + 1):
        now = now.join(up, F.col("ancestor") == F.col("_c")).select("child", F.col("_p").alias("ancestor"), F.lit(k).alias("distance"))
        out = out.union(now)
    return out


def banded_expansion(seeds: DataFrame, edges: DataFrame, low: float = 0.3, high: float = 0.9, limits: tuple[int, int] = (20, 40)) -> DataFrame:
    """(seed, b, hops): a seed (id, score) under `low` isn't expanded, one up to `high` by one hop and at most limits[0]
    neighbours, one above by up to two hops and at most limits[1]. A path doesn't use an edge twice."""
    sym = both_ways(edges.withColumn("rel", F.xxhash64("src", "rel", "dst"))).select("a", F.col("rel").alias("edge"), "b")
    one = seeds.where(F.col("score") >= low).join(sym, F.col("id") == F.col("a")).select(F.col("id").alias("seed"), "score", "b", "edge", F.lit(1).alias("hops"))
    nxt = sym.select(F.col("a").alias("_a"), F.col("edge").alias("_e"), F.col("b").alias("_b"))
    two = one.where(F.col("score") > high).join(nxt, (F.col("b") == F.col("_a")) & (F.col("edge") != F.col("_e"))).select("seed", "score", F.col("_b").alias("b"), F.col("_e").alias("edge"), F.lit(2).alias("hops"))
    reached = one.union(two).where("b <> seed").groupBy("seed", "score", "b").agg(F.min("hops").alias("hops"))
    most = F.when(F.col("score") > high, limits[1]).otherwise(limits[0])
    n = F.row_number().over(Window.partitionBy("seed").orderBy("hops", "b"))
    return reached.withColumn("n", n).where(F.col("n") <= most).select("seed", "b", "hops")


# ---- algorithms ---------------------------------------------------------------------------------------------------


def projection(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: parallel edges counted, direction dropped, self-loops out."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that edges, in either direction, connect. Alternating large-star and small-star
    rounds; rounds grow with the logarithm of a component's diameter, and each is written to the shared folder."""
    def kept(rows: DataFrame) -> tuple[DataFrame, tuple]:
        """rows written, with their number and a checksum that the writing job takes along."""
        told = Observation()
        out = saved(rows.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        return out, (told.get["n"], told.get["h"])

    now, before = kept(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    for _ in range(max_rounds):
        sym = now.union(now.select("v", "u"))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        now, totals = kept(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v").distinct())
        if totals == before:
            break
        before = totals
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now, nodes["id"] == now["u"], "left").select("id", F.coalesce("v", "id").alias("component"))


def label_communities(weighted: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, community): weighted label propagation on (a, b, weight); ties to the smaller label. The fast path.

    Edges are kept by their first end, so that votes are mostly counted where they are read; in the first round the neighbours are the labels."""
    sym = saved(weighted.select("a", "b", "weight").union(weighted.select("b", "a", "weight")).repartition("a").groupBy("a", "b").agg(F.sum("weight").alias("weight")).sortWithinPartitions("a"))
    now = None
    for _ in range(rounds):
        if now is None:
            votes = sym.select("a", F.col("b").alias("community"), F.col("weight").alias("w"))
        else:
            votes = sym.join(now, sym["b"] == now["id"]).groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("best"))
        now = saved(best.select(F.col("a").alias("id"), F.least("best.community", "a").alias("community")))
    return sym.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")) if now is None else now


def modularity(weighted: DataFrame, membership: DataFrame) -> DataFrame:
    """One row, modularity: of a partition (id, community) of the graph (a, b, weight)."""
    sym = weighted.select("a", "b", "weight").union(weighted.select("b", "a", "weight"))
    of = membership.select(F.col("id").alias("_i"), F.col("community").alias("_c"))
    ca = sym.join(of, F.col("a") == F.col("_i")).select("b", "weight", F.col("_c").alias("ca"))
    both = ca.join(of, F.col("b") == F.col("_i")).select("weight", "ca", F.col("_c").alias("cb"))
    inside = F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0))
    by = both.groupBy("ca").agg(F.sum("weight").alias("degree"), inside.alias("inside"))
    total = by.agg(F.sum("degree").alias("m2"))
    parts = by.crossJoin(F.broadcast(total)).select((F.col("inside") / F.col("m2") - (F.col("degree") / F.col("m2")) ** 2).alias("q"))
    return parts.agg(F.sum("q").alias("modularity"))


def ordered_numbers(ids: DataFrame) -> DataFrame:
    """(id, n) for the distinct ids: numbers in the order of the ids, whose last bit is that of the id's hash."""
    n = F.monotonically_increasing_id() * 2 + F.pmod(F.xxhash64("id"), F.lit(2))  # sorted into ranges: numbers grow with partitions and within them
    return saved(ids.select("id").distinct().orderBy("id").select("id", n.alias("n")))


def communities(weighted: DataFrame, levels: int = 3, rounds: int = 6) -> DataFrame:
    """(id, level, community): hierarchical communities by local moving and aggregation, level 0 the finest.

    In a round every node may move to the neighbouring community of the greatest modularity gain (ties to the smaller
    id); nodes of even and odd hash move in turn, which keeps neighbours from swapping. Communities then become the nodes
    of the next level. Moves that split a community are undone by taking its connected parts (refinement).

    Nodes are numbered in their order. Edges are kept in both directions by their first end: a round reads those of the nodes that may move, adds them up
    where they are read, and shuffles sums for each node and community. Parts are found after each node has met its least neighbour in its community."""
    given = saved(weighted.select("a", "b", F.col("weight").cast("double").alias("weight")))
    nodes = ordered_numbers(given.select(F.col("a").alias("id")).union(given.select("b")))
    small = F.broadcast if nodes.count() <= NUMBERED else (lambda df: df)

    def of(rows: DataFrame, end: str, table: DataFrame, **columns: str) -> DataFrame:
        """rows with columns of table (id, ...) for the node in the column end."""
        return rows.join(small(table.select(F.col("id").alias(end), *(F.col(c).alias(name) for name, c in columns.items()))), end)

    graph = of(of(given, "a", nodes, na="n"), "b", nodes, nb="n").select(F.col("na").alias("a"), F.col("nb").alias("b"), "weight")
    parts, names = [], nodes.select(F.col("n").alias("id"), F.col("n").alias("community"))
    for level in range(levels):
        ways = graph.union(graph.where("a <> b").select("b", "a", "weight"))
        kept = saved(ways.repartition("a").groupBy("a", "b").agg(F.sum("weight").alias("weight")).sortWithinPartitions("a"))
        sym = kept.where("a <> b")
        degree = saved(kept.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(F.col("weight"))).alias("k")))
        m2 = degree.agg(F.sum("k")).first()[0]
        if not m2:
            break
        now = degree.select(F.col("a").alias("id"), F.col("a").alias("c"), "k")
        for turn in range(rounds):
            totals = saved(now.groupBy("c").agg(F.sum("k").alias("tot")).withColumnRenamed("c", "id"))
            moving = sym.where(F.col("a").bitwiseAND(1) == turn % 2)
            if turn == 0:
                to = moving.select("a", F.col("b").alias("c"), F.col("weight").alias("w"))  # each node is its own community yet
            else:
                to = of(moving, "b", now, c="c").groupBy("a", "c").agg(F.sum("weight").alias("w"))
            gain = of(of(to, "c", totals, tot="tot"), "a", now, k="k", own="c")
            tot = F.when(F.col("c") == F.col("own"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
            scored = gain.select("a", "c", "own", "k", F.round(F.col("w") - F.col("k") * tot / m2, 9).alias("g"))
            stay = F.max(F.when(F.col("c") == F.col("own"), F.col("g"))).alias("stay")
            best = scored.groupBy("a").agg(F.min(F.struct((-F.col("g")).alias("g"), "c")).alias("best"), stay, F.first("own").alias("own"), F.first("k").alias("k"))
            here = F.coalesce("stay", -F.col("k") * (F.col("own_tot") - F.col("k")) / m2)
            moved = of(best, "own", totals, own_tot="tot").where(-F.col("best.g") > here + 1e-9).select(F.col("a").alias("id"), F.col("best.c").alias("to"))
            now = saved(now.join(moved, "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k"))
        inside = of(of(sym, "a", now, ca="c"), "b", now, cb="c").where("ca = cb").select("a", "b")
        least = inside.groupBy("a").agg(F.min("b").alias("b"))
        met = saved(now.join(least, F.col("id") == F.col("a"), "left").select("id", F.least("id", "b").alias("m")))
        links = of(of(inside.where("a < b"), "a", met, src="m"), "b", met, dst="m").where("src <> dst").select("src", "dst").distinct()
        refined = components(met.select(F.col("m").alias("id")).distinct(), links)
        refined = saved(met.join(refined.withColumnRenamed("id", "m"), "m").select("id", F.col("component").alias("c")))
        names = saved(of(names, "community", refined, c="c").select("id", F.col("c").alias("community")))
        parts.append(names.select("id", F.lit(level).alias("level"), "community"))
        if level + 1 < levels:
            ends = of(of(kept.where("a <= b"), "a", refined, ca="c"), "b", refined, cb="c")
            graph = saved(ends.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")))
    out = names.select("id", F.lit(0).alias("level"), "community").where("false")
    for part in parts:
        out = out.union(part)
    called = nodes.select(F.col("n").alias("id"), F.col("id").alias("name"))
    return of(of(out, "id", called, name="name"), "community", called, named="name").select(F.col("name").alias("id"), "level", F.col("named").alias("community"))


def community_levels(membership: DataFrame) -> DataFrame:
    """From (id, communities array, finest first) the edges (child, rel, parent): IN_COMMUNITY to level 0 and
    PARENT_COMMUNITY from each level to the next. A community's id is level-number."""
    named = membership.select("id", F.transform("communities", lambda c, i: F.concat_ws("-", i.cast("string"), c.cast("string"))).alias("c"))
    own = named.where(F.size("c") > 0).select(F.col("id").alias("child"), F.lit("IN_COMMUNITY").alias("rel"), F.get("c", 0).alias("parent"))
    up = named.select(F.posexplode("c").alias("i", "child"), "c").where(F.col("i") + 1 < F.size("c")).select("child", F.lit("PARENT_COMMUNITY").alias("rel"), F.get("c", F.col("i") + 1).alias("parent"))
    return own.union(up).distinct()


def induced(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, src, rel, dst): edges with both ends in one community of (id, community)."""
    a, b = membership.select(F.col("id").alias("src"), F.col("community").alias("ca")), membership.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    return edges.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("ca").alias("community"), "src", "rel", "dst")


# ---- maintenance --------------------------------------------------------------------------------------------------


def merged(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after each duplicate of mapping (duplicate, keep) has become its keeper: the keeper's properties
    stay, edges are redirected, and edges that this makes loops or repeats go."""
    to = mapping.select("duplicate", "keep")
    left = nodes.join(to, nodes["id"] == to["duplicate"], "left_anti")
    src = edges.join(to.select(F.col("duplicate").alias("src"), F.col("keep").alias("_s")), "src", "left")
    both = src.join(to.select(F.col("duplicate").alias("dst"), F.col("keep").alias("_d")), "dst", "left")
    moved = both.select(F.coalesce("_s", "src").alias("src"), "rel", F.coalesce("_d", "dst").alias("dst")).where("src <> dst").distinct()
    return left, moved


def without_documents(chunk_doc: DataFrame, chunk_entity: DataFrame, documents: Sequence, drop_entities: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks left, mentions left, entities dropped) after documents are deleted; entities that other documents mention stay."""
    chunks = chunk_doc.where(~F.col("doc").isin(list(documents)))
    mentions = chunk_entity.join(chunks.select("chunk"), "chunk", "left_semi")
    gone = chunk_entity.join(chunks.select("chunk"), "chunk", "left_anti").select("entity").distinct()
    dropped = gone.join(mentions.select("entity"), "entity", "left_anti") if drop_entities else gone.limit(0)
    return chunks, mentions, dropped


def similar_edges(vectors: DataFrame, id_col: str, vector_col: str, k: int = 6, threshold: float = 0.8, max_degree: int = 5) -> DataFrame:
    """(src, dst, score): each vector's k nearest (itself among them) of similarity (1 + cosine) / 2 of at least threshold,
    at most max_degree a vector."""
    from veritrail.operators.neighbours import nearest

    found = nearest(vectors, vectors, k, id_col, vector_col).where("query_id <> id").withColumn("score", (1 + F.col("cosine")) / 2).where(F.col("score") >= threshold)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("n", n).where(F.col("n") <= max_degree).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "score")


def reviewed(statuses: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, status, supersedes): the latest decision (id, status, at) of each fact over its given status."""
    last = decisions.groupBy("id").agg(F.max(F.struct("at", F.col("status").alias("decided"))).alias("d"), F.count("*").alias("n"))
    joined = statuses.join(last, "id", "left")
    return joined.select("id", F.coalesce("d.decided", "status").alias("status"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("supersedes"))


def assertions(edges: DataFrame, evidence_col: str) -> DataFrame:
    """Edges reified: an assertion id of source, relation, target and evidence."""
    from veritrail.functions.ids import stable_id

    return edges.withColumn("assertion_id", stable_id("assertion", F.concat_ws(":", "src", "rel", "dst", evidence_col)))


