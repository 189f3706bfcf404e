"""Every query of the library by name, with its DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

from veritrail.plans.catalog import ORACLE_SQL, QUERIES, Tables

MODULES = ["q_text", "q_predicates", "q_relational", "q_graph", "q_retrieval", "q_streams"]
for _name in MODULES:
    import_module(f"veritrail.plans.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    from veritrail.operators.retrieval import cross_corpus_search

    return cross_corpus_search(Tables(spark, sf_dir).documents)
