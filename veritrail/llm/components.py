"""Connected components by large-star and small-star rounds, and joins that split hot keys.

Each round's rows are written to the shared folder. Nothing but three totals of a round comes to the driver. The hub of a
large component is a hot key: once some node has over HOT edges, edges are dealt by node and a part of their other end,
and the node's minimum is sent to each of its parts that occurs. The same split serves any join of many rows with a table
of one row for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import apart, written

HOT, PARTS = 1000, 64


def joined(rows: DataFrame, table: DataFrame, key: str, spread: str, most: int) -> DataFrame:
    """rows joined with table (one row for each key) on key. most: the rows of the commonest key; if these are over HOT,
    keys are split in PARTS by a hash of the column spread, and table is repeated for the parts that occur."""
    if most <= HOT:
        return rows.join(apart(table), key)
    part = "_vt_part"
    split = rows.withColumn(part, F.pmod(F.xxhash64(spread), F.lit(PARTS)))
    occurring = split.select(key, part).distinct().join(apart(table), key)  # at most PARTS rows for a key, merged before their shuffle
    return split.join(apart(occurring), [key, part]).drop(part)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its connected component.

    Both steps of a round keep components as they are; after a logarithmic number of rounds every component is a star
    around its smallest node. Loops and repeated edges are allowed; an empty table gives an empty result."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degrees = both.groupBy("u").agg(F.count("*").alias("n"), mark.alias("mark"))
        n, mark, most = degrees.agg(F.sum("n"), F.sum("mark"), F.max("n")).first()
        if (n, mark) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, most = (n, mark), most or 0
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both, least, "u", "v", most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, smallest, "u", "v", most)
        now = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct(),
            "stars",
        )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def named(members: DataFrame, links: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, component_id) for each of members (key, id_col: the least id of its rows): the least id of those that
    links (a, b) between keys reach."""
    root = written(components(links), "roots")
    most = root.groupBy("root").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rooted = root.join(apart(members), F.col("node") == F.col(key)).select(key, id_col, "root")
    parts = rooted.groupBy("root", F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("part")).agg(F.min(id_col).alias("least"))
    least = parts.groupBy("root").agg(F.min("least").alias("component_id"))
    inside = joined(rooted, least, "root", key, most).select(key, "component_id")
    alone = members.join(apart(root), members[key] == root["node"], "left_anti").select(key, F.col(id_col).alias("component_id"))
    return inside.unionByName(alone)
