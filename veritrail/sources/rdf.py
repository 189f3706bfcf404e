"""RDF triples of a property graph, written as N-Triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Properties that are left out, labels that are, and numbers that are decimals.
DROPPED, HIDDEN, DECIMALS = ("embedding", "metadata_json"), ("CanonicalEntity",), ("numeric_value", "value_min", "value_max", "confidence")


def iri(identifier: Column) -> Column:
    return F.replace(F.url_encode(identifier), F.lit("+"), F.lit("%20"))


def triples(nodes: DataFrame, edges: DataFrame, name_space: str = "") -> DataFrame:
    """s, p, o, datatype from nodes (id, labels, props map<string,string>) and edges (src, rel, dst)."""
    s = F.concat(F.lit(name_space), iri(F.col("id")))
    types = nodes.select(s.alias("s"), F.lit("type").alias("p"), F.explode("labels").alias("o"), F.lit("iri").alias("datatype")).where(~F.col("o").isin(*HIDDEN))
    props = nodes.select(s.alias("s"), F.explode("props").alias("p", "o")).where(F.col("o").isNotNull() & ~F.col("p").isin(*DROPPED))
    props = props.select("s", "p", "o", F.when(F.col("p").isin(*DECIMALS), "decimal").otherwise("string").alias("datatype"))
    rels = edges.select(F.concat(F.lit(name_space), iri(F.col("src"))), "rel", F.concat(F.lit(name_space), iri(F.col("dst"))), F.lit("iri"))
    return types.union(props).union(rels)


def n_triples(rows: DataFrame, name_space: str) -> DataFrame:
    """One column, value: a line of N-Triples for each row; write it with .write.text."""
    escaped = F.replace(F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), F.when(F.col("datatype") == "decimal", "^^<http://www.w3.org/2001/XMLSchema#decimal>").otherwise(""))
    o = F.when(F.col("datatype") == "iri", F.concat(F.lit(f"<{name_space}"), F.col("o"), F.lit(">"))).otherwise(literal)
    p = F.when(F.col("p") == "type", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>").otherwise(F.concat(F.lit(f"<{name_space}"), F.col("p"), F.lit(">")))
    return rows.select(F.concat(F.lit(f"<{name_space}"), F.col("s"), F.lit("> "), p, F.lit(" "), o, F.lit(" .")).alias("value"))
