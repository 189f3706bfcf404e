from veritrail.llm.common import table
from veritrail.llm.url_filter import judge

BLOCK = [("com", "/en/"), ("example.net", "/de/8"), ("org", "/es/")]
ALLOW = [("example.com", "/en/7"), ("net", "/de/")]


def op1_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), BLOCK, ALLOW, "page_id", "url", default="allow")


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for rules, v in ((BLOCK, "block"), (ALLOW, "allow")) for h, p in rules)
ORACLE_SQL = {
    "op1_url_filter": rf"""
WITH rules(h, p, v) AS (VALUES {_RULES}),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p DESC) AS n
    FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT c.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM cut c LEFT JOIN hit ON c.page_id = hit.page_id AND n = 1
"""
}
QUERIES = {"op1_url_filter": op1_url_filter}
