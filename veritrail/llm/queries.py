"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from importlib import import_module

MODULES = ["q_url_filter", "q_mil", "q_token_counts", "q_topk", "q_quality_rules", "q_bpe", "q_warc", "q_mixing", "q_langid", "q_simhash", "q_filter_audit", "q_fim", "q_recompression"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"veritrail.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
