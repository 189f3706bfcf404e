"""The star schema read as an evidence graph, for queries over graphs: as DataFrames, and as SQL for their oracles.

nodes (id, label, name, confidence, status) and edges (src, rel, dst): customers, orders (as experiments), parts (materials),
suppliers (equipment), priorities (processes), line items (measurements), nations and regions (communities).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


#: Kinds of ids, by the three last bits of their numbers.
KINDS = "copsnr"


def number(kind: str, column: str) -> Column:
    """An id as a number, for queries that shuffle many of them: keys up to 2**60 either way; a larger one is an error."""
    return F.col(column).cast("long") * 8 + KINDS.index(kind)


def named(number: Column) -> Column:
    """The id of a number."""
    kind = F.substr(F.lit(KINDS), number.bitwiseAND(7).cast("int") + 1, F.lit(1))
    return F.concat(kind, F.lit(":"), F.shiftright(number, 3).cast("string"))


def nodes(t) -> DataFrame:
    null = F.lit(None).cast("double")
    kinds = [
        t.customer.select(key("c", "c_custkey").alias("id"), F.lit("Customer").alias("label"), F.col("c_name").alias("name"), null.alias("confidence"), F.col("c_mktsegment").alias("status")),
        t.orders.select(key("o", "o_orderkey"), F.lit("Experiment"), key("order", "o_orderkey"), (F.col("o_orderkey") % 100 / 100.0), F.col("o_orderstatus")),
        t.part.select(key("p", "p_partkey"), F.lit("Material"), F.col("p_name"), null, F.col("p_brand")),
        t.supplier.select(key("s", "s_suppkey"), F.lit("Equipment"), F.col("s_name"), null, F.lit(None).cast("string")),
        t.nation.select(key("n", "n_nationkey"), F.lit("Nation"), F.col("n_name"), null, F.lit(None).cast("string")),
        t.region.select(key("r", "r_regionkey"), F.lit("Region"), F.col("r_name"), null, F.lit(None).cast("string")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.union(k)
    return out


def edges(t) -> DataFrame:
    return every_edge(t).distinct()


def every_edge(t, key=key) -> DataFrame:
    """The edges with their repeats, for queries that make their rows distinct later. key: how an id is made of its kind and column."""
    return (
        t.orders.select(key("c", "o_custkey").alias("src"), F.lit("PLACED").alias("rel"), key("o", "o_orderkey").alias("dst"))
        .union(t.lineitem.select(key("o", "l_orderkey"), F.lit("USES_MATERIAL"), key("p", "l_partkey")))
        .union(t.lineitem.select(key("o", "l_orderkey"), F.lit("USES_EQUIPMENT"), key("s", "l_suppkey")))
        .union(t.customer.select(key("c", "c_custkey"), F.lit("IN_COMMUNITY"), key("n", "c_nationkey")))
        .union(t.supplier.select(key("s", "s_suppkey"), F.lit("IN_COMMUNITY"), key("n", "s_nationkey")))
        .union(t.nation.select(key("n", "n_nationkey"), F.lit("PARENT_COMMUNITY"), key("r", "n_regionkey")))
    )


NODES_SQL = """nodes AS (
  SELECT 'c:' || c_custkey AS id, 'Customer' AS label, c_name AS name, NULL::DOUBLE AS confidence, c_mktsegment AS status FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'Experiment', 'order:' || o_orderkey, o_orderkey % 100 / 100.0, o_orderstatus FROM orders
  UNION ALL SELECT 'p:' || p_partkey, 'Material', p_name, NULL, p_brand FROM part
  UNION ALL SELECT 's:' || s_suppkey, 'Equipment', s_name, NULL, NULL FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'Nation', n_name, NULL, NULL FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'Region', r_name, NULL, NULL FROM region)"""
EDGES_SQL = """edges AS (
  SELECT 'c:' || o_custkey AS src, 'PLACED' AS rel, 'o:' || o_orderkey AS dst FROM orders
  UNION SELECT 'o:' || l_orderkey, 'USES_MATERIAL', 'p:' || l_partkey FROM lineitem
  UNION SELECT 'o:' || l_orderkey, 'USES_EQUIPMENT', 's:' || l_suppkey FROM lineitem
  UNION SELECT 'c:' || c_custkey, 'IN_COMMUNITY', 'n:' || c_nationkey FROM customer
  UNION SELECT 's:' || s_suppkey, 'IN_COMMUNITY', 'n:' || s_nationkey FROM supplier
  UNION SELECT 'n:' || n_nationkey, 'PARENT_COMMUNITY', 'r:' || n_regionkey FROM nation)"""
