from veritrail.llm.common import table
from veritrail.llm.warc import round_trip


def op7_warc(spark, sf_dir):
    found = round_trip(table(spark, sf_dir, "pages"), "page_id", url_col="url", html_col="html", min_revisit=1000)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS most FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND most <> page_id AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN most END AS refers_to FROM r
"""
}
QUERIES = {"op7_warc": op7_warc}
