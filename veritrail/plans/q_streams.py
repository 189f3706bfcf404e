"""Sources, sinks and streams (S and ST entries) over the provided tables."""

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import urls
from veritrail.operators.align import minute_buckets, tumbling_minutes
from veritrail.operators.graph import _own_folder
from veritrail.plans import substrate
from veritrail.plans.catalog import ORACLE_SQL, QUERIES, Tables, query
from veritrail.sources import citations, objects, openxml, readers, sinks
from veritrail.streaming import cache, jobs, ledger, live


def _scratch(spark) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{_own_folder()}"
    return os.path.join(folder, "streams", uuid.uuid4().hex)


def _streamed(name, sql=None):
    """Registers a query that runs a stream (spark, sf_dir) -> path over a folder's events to a table, and reads that."""

    def add(make):
        QUERIES[name] = make
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return add


# ---- sources ------------------------------------------------------------------------------------------------------


@query(
    "s1_parsed_documents",
    "SELECT 'doc' || doc_id || '.txt' AS file_name, 'docver_' || sha256(coalesce(text, '')) AS version_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS size_bytes FROM documents",
)
def s1(t):
    """The documents as text files of one folder."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = t.documents.select(F.concat(F.lit("/in/"), name).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return readers.parsed_documents(files).select("file_name", "version_id", "sha256", F.col("size_bytes").cast("long").alias("size_bytes"))


@query("s3_table_rows", "SELECT o_orderkey, o_orderstatus || ' | ' || o_orderpriority AS text FROM orders")
def s3(t):
    tables = t.orders.select("o_orderkey", F.array(F.array("o_orderstatus", "o_orderpriority"), F.array(F.lit(" "), F.lit(None).cast("string"))).alias("cells"))
    return readers.table_rows(tables, "o_orderkey", "cells").select("o_orderkey", "text")


@query("s4_figure_gates", "SELECT DISTINCT sha256(p_brand) AS sha FROM part WHERE p_size * 10 >= 200 AND p_size * 6 >= 120 AND p_retailprice * 10 >= 8000")
def s4(t):
    figures = t.part.select((F.col("p_size") * 10).alias("width"), (F.col("p_size") * 6).alias("height"), (F.col("p_retailprice") * 10).alias("bytes"), F.sha2("p_brand", 256).alias("sha256"))
    return readers.kept_figures(figures).select(F.col("sha256").alias("sha"))


@query(
    "s6_pseudo_pages",
    """WITH RECURSIVE p AS (SELECT conv_id AS doc, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM conversations),
    f AS (SELECT doc, n, t AS held, len(t) > 900 AS closed, 1 AS page FROM p WHERE n = 1 UNION ALL
      SELECT p.doc, p.n, CASE WHEN closed OR held = '' THEN p.t WHEN p.t = '' THEN held ELSE held || chr(10) || p.t END, len(CASE WHEN closed OR held = '' THEN p.t WHEN p.t = '' THEN held ELSE held || chr(10) || p.t END) > 900, page + closed::INT FROM f JOIN p ON p.doc = f.doc AND p.n = f.n + 1)
    SELECT doc, page::INT AS page_number, max_by(held, n) AS text FROM f GROUP BY ALL HAVING max_by(held, n) <> ''""",
)
def s6(t):
    paragraphs = t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("position"), "text", F.lit(False).alias("page_break"))
    return readers.pseudo_pages(paragraphs, size=900)


@_streamed("s9_workbook_rows", "SELECT c_custkey || ' | ' || c_name || ' | ' || c_mktsegment AS text FROM customer")
def s9(spark, sf_dir):
    """A sheet with a header, written as delimited text and read back."""
    folder = f"{_scratch(spark)}/sheet"
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(folder)
    return readers.workbook_rows(spark, folder)


@query("s10_category_inventory", "SELECT source AS category, count(*) AS n FROM documents GROUP BY 1")
def s10(t):
    return t.documents.groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n"))


@query("s12_pages_regrouped", "SELECT conv_id, turn // 4 AS page, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL")
def s12(t):
    return readers.pages_regrouped(t.conversations.withColumn("page", F.floor(F.col("turn") / 4)), "conv_id", "page", "turn", "text")


@query("s13_object_listing", "SELECT url FROM pages WHERE NOT ends_with(url, '/') AND len(html) > 0")
def s13(t):
    return readers.listed_objects(t.pages.select(F.col("url").alias("key"), F.length("html").alias("size"))).select(F.col("key").alias("url"))


@query(
    "s14_web_pages",
    r"""WITH a AS (SELECT page_id, url, coalesce(nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), ''), regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$')) AS title,
    regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM pages),
    b AS (SELECT page_id, url, title, trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text, count(*) OVER (PARTITION BY title) AS n FROM a)
    SELECT page_id, url, CASE WHEN n > 1 THEN title || '-' || regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$') ELSE title END AS title, text FROM b""",
)
def s14(t):
    return readers.web_pages(t.pages, "page_id", "url", "html")


@query(
    "s8_slides",
    r"""WITH t AS (SELECT 'conv' || conv_id || '.pptx' AS path, role, turn, array_to_string(list_filter(list_transform(str_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INT AS n FROM conversations)
    SELECT path, n AS slide_number, 'table' AS kind, 'Slide ' || n || ' table' AS text FROM t UNION ALL SELECT path, n, 'table_row', role || ' | ' || turn FROM t
    UNION ALL SELECT path, n, 'text', CASE WHEN said <> '' THEN said || chr(10) ELSE '' END || 'Speaker notes: turn ' || turn FROM t""",
)
def s8(t):
    """Each conversation as a presentation of a slide for each turn, and back."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return openxml.elements(readers.presentations(turns, F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".pptx")), "t")).select("path", "slide_number", "kind", "text")


@query("s9_workbook_sheets", "SELECT 'nation' || s_nationkey || '.xlsx' AS path, 'suppliers' AS sheet_name, s_name || ' |  | ' || s_suppkey AS text, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS row_number FROM supplier")
def s9b(t):
    """The suppliers of each nation as a workbook, and back."""
    cells = F.array_sort(F.collect_list(F.struct("s_suppkey", F.array("s_name", F.lit(""), F.col("s_suppkey").cast("string")).alias("cells"))))
    rows = t.supplier.groupBy("s_nationkey").agg(F.transform(cells, lambda x: x["cells"]).alias("rows"))
    files = readers.workbooks(rows, F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit(".xlsx")), F.lit("suppliers"), "rows")
    return openxml.elements(files).where("kind = 'table_row'").select("path", "sheet_name", "text", "row_number")


_ALLOWED, _THIN = ["example.com", "Example.org"], ["example.org"]


@query(
    "s20_citation_tiers",
    r"""WITH c AS (SELECT page_id // 4 AS answer, page_id % 4 AS k, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '(?i)^https?://', '') ELSE url END AS raw, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'Page ' || page_id END AS title FROM pages),
    d AS (SELECT answer, k AS place, raw, title FROM c UNION ALL SELECT answer, k + 4, raw, 'again' FROM c), u AS (SELECT *, CASE WHEN regexp_matches(raw, '(?i)^https?://') THEN trim(raw) ELSE 'https://' || trim(raw) END AS url FROM d),
    h AS (SELECT *, lower(regexp_replace(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1), ':[0-9]*$', '')) AS host FROM u),
    f AS (SELECT * FROM h WHERE host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org' OR ends_with(host, '.example.org') QUALIFY row_number() OVER (PARTITION BY answer, url ORDER BY place) = 1),
    m AS (SELECT *, host = 'example.org' OR ends_with(host, '.example.org') AS thin FROM f)
    SELECT answer, url, coalesce(title, host) AS title, CASE WHEN thin THEN 'web_metadata' ELSE 'web' END AS source_type, thin AS metadata_only, CASE WHEN thin THEN 'metadata' ELSE 'science' END AS evidence_tier FROM m""",
)
def s20(t):
    """Answers that cite four pages each, twice, in JSON: their sources by tier."""
    raw = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "(?i)^https?://", "")).otherwise(F.col("url"))
    title = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("Page "), F.col("page_id").cast("string")))
    one = lambda title: F.struct(F.lit("url_citation").alias("type"), raw.alias("url"), title.alias("title"))
    by = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("page_id", x.alias("c")))), lambda x: x["c"])
    told = t.pages.groupBy(F.floor(F.col("page_id") / 4).alias("answer")).agg(by(one(title)).alias("first"), by(one(F.lit("again"))).alias("second"))
    content = F.struct(F.lit("output_text").alias("type"), F.concat("first", "second").alias("annotations"))
    answers = told.select("answer", F.to_json(F.struct(F.array(F.struct(F.array(content).alias("content"))).alias("output"))).alias("json"))
    cited = answers.select("answer", F.posexplode(citations.annotations(F.col("json"))).alias("place", "c")).select("answer", "place", "c.url", "c.title")
    return citations.cited_sources(cited, _ALLOWED, "science", _THIN).select("answer", "url", "title", "source_type", "metadata_only", "evidence_tier")


@query("s15_article_urls", "SELECT page_id, 'en' AS lang, 'Page_' || page_id AS title FROM pages WHERE page_id % 2 = 0")
def s15(t):
    made = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/Page_"), F.col("page_id").cast("string"), F.lit("?x=1"))).otherwise(F.col("url"))
    part = urls.wiki_parts(made)
    return t.pages.select("page_id", part["lang"].alias("lang"), part["title"].alias("title")).where("title is not null")


@query(
    "s16_st1_minute_buckets",
    """WITH RECURSIVE p AS (SELECT conv_id AS video, turn * 25 AS start, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations),
    f AS (SELECT video, n, start, text, 0 AS bucket, start >= 60 AS closed, 60 AS mark FROM p WHERE n = 1 UNION ALL
      SELECT p.video, p.n, p.start, p.text, bucket + closed::INT, p.start >= mark + 60 * closed::INT, mark + 60 * closed::INT FROM f JOIN p ON p.video = f.video AND p.n = f.n + 1)
    SELECT video, bucket, min(start) AS start_time, max(start) AS end_time, string_agg(text, ' ' ORDER BY n) AS text FROM f GROUP BY ALL""",
)
def s16(t):
    segments = t.conversations.select(F.col("conv_id").alias("video"), (F.col("turn") * 25).alias("start"), "text")
    return minute_buckets(segments)


@query("st1_tumbling_minutes", "SELECT conv_id AS video, turn * 25 // 60 AS bucket, min(turn * 25) AS start_time, max(turn * 25) AS end_time, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY ALL")
def st1(t):
    return tumbling_minutes(t.conversations.select(F.col("conv_id").alias("video"), (F.col("turn") * 25).alias("start"), "text"))


@query("s18_merged_parts", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY 1")
def s18(t):
    return readers.merged_parts(t.conversations.withColumn("part", F.col("turn") + 1 - F.min("turn").over(Window.partitionBy("conv_id"))), "conv_id", "part", "text")


@query("s19_st11_upload_jobs", "SELECT sha256(text) AS sha256, min('doc' || doc_id) AS name FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY 1")
def s19(t):
    uploads = t.documents.select(F.sha2("text", 256).alias("sha256"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("n_chars").alias("size"))
    return readers.upload_jobs(uploads, t.documents.where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("sha256"))).select("sha256", "name")


@query("s31_partial_targets", "SELECT o_orderkey AS job_id, o_orderstatus AS stage, count(*) AS n_chunks FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def s31(t):
    jobs_ = t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("stage"), F.col("o_orderkey").alias("document_id"))
    chunks = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_id"))
    return readers.partial_targets(jobs_, chunks).select("job_id", "stage", "n_chunks")


@_streamed(
    "s22_graph_source",
    f"WITH {substrate.NODES_SQL}, {substrate.EDGES_SQL} SELECT 'node' AS kind, id AS a, label AS b, NULL AS c FROM nodes UNION ALL SELECT 'edge', src, rel, dst FROM edges",
)
def s22(spark, sf_dir):
    """The graph of all tables written as lines of text, and read again."""
    t = Tables(spark, sf_dir)
    lines = substrate.nodes(t).select(F.concat_ws("\t", F.lit("node"), "id", "label").alias("value")).union(substrate.edges(t).select(F.concat_ws("\t", F.lit("edge"), "src", "rel", "dst")))
    path = f"{_scratch(spark)}/lines"
    lines.write.text(path)
    return readers.graph_lines(spark.read.text(path))


@query(
    "s7_text_documents",
    r"""WITH d AS (SELECT 'item' || item_id || '.docx' AS path, item_id, list_filter(list_transform(str_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS said FROM benchmark)
    SELECT path, 'text' AS kind, unnest(said) AS text, unnest(range(len(said)))::INT AS position FROM d UNION ALL SELECT path, 'table_row', 'item | ' || item_id, len(said)::INT FROM d""",
)
def s7(t):
    """Each benchmark item as a text document of its lines and a table, and back."""
    path = F.concat(F.lit("item"), F.col("item_id").cast("string"), F.lit(".docx"))
    files = readers.text_documents(t.benchmark, path, F.split("text", "\n"), F.array(F.lit("item"), F.col("item_id").cast("string")))
    return readers.openxml_elements(files).select("path", "kind", "text", "position")


@_streamed("s23_corpus_folders", "SELECT doc_id, source AS corpus_id, sha256(text) AS digest FROM documents")
def s23(spark, sf_dir):
    """All documents written by corpus and read again; the corpus comes back from the folders' names."""
    path = f"{_scratch(spark)}/corpus"
    sinks.write_corpus(Tables(spark, sf_dir).documents.select("doc_id", F.col("source").alias("corpus_id"), "text"), path)
    return spark.read.parquet(path).select("doc_id", F.col("corpus_id").cast("string").alias("corpus_id"), F.sha2("text", 256).alias("digest"))


@_streamed("s17_merged_objects", "SELECT 'conv' || conv_id AS upload, string_agg(text || chr(10), '' ORDER BY turn) AS text, count(*)::INT AS parts FROM conversations GROUP BY 1")
def s17(spark, sf_dir):
    """All conversations uploaded in parts, one for each turn, and merged."""
    root = f"{_scratch(spark)}/objects"
    turns = Tables(spark, sf_dir).conversations
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    content = F.encode(F.concat("text", F.lit("\n")), "UTF-8")
    store = objects.PartStore(spark, root)
    store.pack(turns.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("upload"), number.alias("part"), content.alias("content")))
    return store.run().select("upload", F.decode("content", "UTF-8").alias("text"), "parts")


@_streamed("s26_spool", "SELECT conv_id, turn, role, sha256(text) AS digest FROM conversations")
def s26(spark, sf_dir):
    """All turns spooled as compressed lines of JSON and read again."""
    path = f"{_scratch(spark)}/spool"
    turns = Tables(spark, sf_dir).conversations
    sinks.spool(turns, path)
    return spark.read.schema(turns.schema).json(path).select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))


# ---- streams ------------------------------------------------------------------------------------------------------


@_streamed("st2_event_tail", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500")
def st2(spark, sf_dir):
    """The whole tail after a cursor, as a stream with a checkpoint; a second run from it finds nothing new."""
    scratch = _scratch(spark)
    stream = live.event_stream(spark, sf_dir, "events.parquet").where("event_id > 500").select("event_id", "user_id", "event_type")
    for _ in range(2):
        live.run_to_table(stream, f"{scratch}/out", f"{scratch}/checkpoint")
    return spark.read.parquet(f"{scratch}/out")


@query("st2_tail_poll", "SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500")
def st2b(t):
    return live.tail(t.events, 100).select("event_id", "event_type")


@query("st3_latest_status", "SELECT user_id, max_by(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY 1")
def st3(t):
    return live.latest_status(t.events)


@query("st4_retry_decision", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'cancelled' WHEN event_id % 5 < 3 THEN 'queued' ELSE 'failed' END AS decision FROM events")
def st4(t):
    return t.events.select("event_id", jobs.retry_decision(F.col("event_id") % 5, F.col("event_id") % 7 == 0).alias("decision"))


@query(
    "st5_stage_attempts",
    """WITH c AS (SELECT *, (coalesce(lag(event_type) OVER w <> event_type, true))::INT AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
    SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id)::INT AS attempt FROM r""",
)
def st5(t):
    return jobs.with_attempts(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_type", ["event_id"]).select("event_id", "attempt")


@query("st6_ttl_cache", "WITH k AS (SELECT *, sha256('search:' || user_id) AS cache_key FROM events) SELECT cache_key, max_by(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM k WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 24 HOUR AND ts < TIMESTAMP '2024-01-15' GROUP BY 1")
def st6(t):
    from veritrail.functions.ids import cache_key
    from veritrail.operators.relational import latest

    now = F.lit("2024-01-15").cast("timestamp_ntz")
    fresh = t.events.where((F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") < now))
    keyed = fresh.withColumn("cache_key", cache_key("search", F.col("user_id").cast("string")))
    return latest(keyed, ["cache_key"], [F.desc("ts"), F.desc("event_id")]).select("cache_key", "event_id")


_REQUESTS = """p AS (SELECT sha256('answer:' || user_id || '|' || event_type || '|policy-1') AS k, event_id, epoch_ms(ts) AS tm, (date_diff('day', DATE '2024-01-01', ts::DATE) // 5)::VARCHAR AS v,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts), event_id) AS n FROM events),
    f AS (SELECT k, n, event_id, 'first' AS outcome, tm AS made, v AS mv, event_id AS answered_by FROM p WHERE n = 1
      UNION ALL SELECT k, n, event_id, outcome, CASE outcome WHEN 'hit' THEN made ELSE tm END, CASE outcome WHEN 'hit' THEN mv ELSE v END, CASE outcome WHEN 'hit' THEN answered_by ELSE event_id END
      FROM (SELECT p.*, made, mv, answered_by, CASE WHEN tm >= made + 259200000 THEN 'expired' WHEN v <> mv THEN 'version' ELSE 'hit' END AS outcome FROM f JOIN p ON p.k = f.k AND p.n = f.n + 1))"""
_CACHED = f"WITH RECURSIVE {_REQUESTS} SELECT k AS cache_key, event_id AS request, outcome, answered_by FROM f"


def _requests(events):
    """Requests by user and kind of event, against a corpus that has a new version every five days."""
    from veritrail.functions.ids import cache_key

    version = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 5).cast("string")
    key = cache_key("answer", F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.lit("policy-1")))
    return events.select(key.alias("cache_key"), F.col("event_id").alias("request"), "ts", version.alias("version"), F.col("props").alias("answer"))


@_streamed("st6_r20_answer_cache_stream", _CACHED)
def st6s(spark, sf_dir):
    """Hits and misses (first, expired, new version) of an answer cache with timers."""
    scratch = _scratch(spark)
    with live.state_in_rocksdb(spark):
        live.run_to_table(cache.answered(_requests(live.event_stream(spark, sf_dir, "events.parquet")), "72 hours"), f"{scratch}/out", f"{scratch}/checkpoint")
    return spark.read.parquet(f"{scratch}/out")


@query("st6_r20_answer_cache_batch", _CACHED)
def st6b(t):
    return cache.answered_batch(_requests(t.events), "72 hours")


@_streamed(
    "st7_adaptive_rate_stream",
    """WITH RECURSIVE p AS (SELECT user_id, event_id, event_type = 'error' AS rejected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, (CASE WHEN rejected THEN 1.5 ELSE 0.98 END)::DOUBLE AS s FROM p WHERE n = 1
      UNION ALL SELECT p.user_id, p.event_id, p.n, CASE WHEN rejected THEN least(60.0::DOUBLE, s * 1.5::DOUBLE) ELSE greatest(0.05::DOUBLE, s * 0.98::DOUBLE) END FROM f JOIN p ON p.user_id = f.user_id AND p.n = f.n + 1)
    SELECT user_id AS worker, event_id AS request, round(s, 6) AS seconds, n AS requests FROM f""",
)
def st7(spark, sf_dir):
    """The spacing of each user's requests, where an error is a rejection."""
    scratch = _scratch(spark)
    events = live.event_stream(spark, sf_dir, "events.parquet")
    requests = events.select(F.col("user_id").alias("worker"), F.col("event_id").alias("request"), (F.col("event_type") == "error").alias("rejected"))
    with live.state_in_rocksdb(spark):
        live.run_to_table(cache.spaced(requests), f"{scratch}/out", f"{scratch}/checkpoint")
    return spark.read.parquet(f"{scratch}/out").withColumn("seconds", F.round("seconds", 6))


@_streamed(
    "st3_run_state_stream",
    """WITH e AS (SELECT user_id, event_id, event_type, epoch_ms(max(ts) OVER w) AS tm, lag(event_type) OVER w AS was, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT *, coalesce(tm - lag(tm) OVER (PARTITION BY user_id ORDER BY event_id) >= 43200000, false) AS gap FROM e),
    m AS (SELECT *, gap OR was IS NULL OR was <> event_type AS changed FROM g),
    n AS (SELECT *, sum(gap::INT + changed::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM m),
    l AS (SELECT user_id, max(event_id) AS event_id, max(tm) AS tm, max(total) AS total FROM n GROUP BY 1)
    SELECT user_id AS run, event_id AS event, event_type AS status, total::BIGINT AS changes FROM n WHERE changed UNION ALL SELECT user_id, before, 'stalled', (total - 1)::BIGINT FROM n WHERE gap
    UNION ALL SELECT user_id, event_id, 'stalled', (total + 1)::BIGINT FROM l WHERE tm + 43200000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""",
)
def st3s(spark, sf_dir):
    """Every change of a run's status; runs stall after twelve hours of silence."""
    scratch = _scratch(spark)
    events = live.event_stream(spark, sf_dir, "events.parquet")
    runs = events.select(F.col("user_id").alias("run"), F.col("event_id").alias("event"), F.col("event_type").alias("status"), "ts")
    with live.state_in_rocksdb(spark):
        live.run_to_table(cache.watched(runs), f"{scratch}/out", f"{scratch}/checkpoint")
    return spark.read.parquet(f"{scratch}/out")


@query("st8_second_pass_capacity", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS turn FROM documents ORDER BY turn, source LIMIT 30")
def st8(t):
    from veritrail.operators.relational import round_robin

    return round_robin(t.documents.select("doc_id", "source"), "source", [F.col("doc_id")], jobs.capacity(600)).select("doc_id", "turn")


@query("st10_monthly_usage", "SELECT user_id, date_trunc('month', ts)::DATE AS month, sum((props->>'$.k')::BIGINT)::BIGINT AS used, greatest(5000 - sum((props->>'$.k')::BIGINT), 0)::BIGINT AS remaining FROM events GROUP BY ALL")
def st10(t):
    return ledger.monthly_usage(t.events, 5000)


@_streamed(
    "st10_daily_usage_stream",
    "SELECT user_id, date_trunc('day', ts)::DATE AS day, sum((props->>'$.k')::BIGINT)::BIGINT AS used FROM events WHERE ts < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY ALL",
)
def st10s(spark, sf_dir):
    """Days that the watermark has closed."""
    scratch = _scratch(spark)
    live.run_to_table(live.daily_usage(live.event_stream(spark, sf_dir, "events.parquet")), f"{scratch}/out", f"{scratch}/checkpoint")
    return spark.read.parquet(f"{scratch}/out")


@_streamed("st11_dedup_stream", "SELECT DISTINCT event_id FROM events")
def st11(spark, sf_dir):
    scratch = _scratch(spark)
    live.run_to_table(live.first_uploads(live.event_stream(spark, sf_dir, "events.parquet"), "event_id").select("event_id"), f"{scratch}/out", f"{scratch}/checkpoint")
    return spark.read.parquet(f"{scratch}/out")


@query("st12_chat_compaction", "SELECT conv_id, left(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 200) AS summary, max_by(text, turn) AS last, count(*)::INT AS n FROM conversations GROUP BY 1")
def st12(t):
    return live.compacted_chats(t.conversations)


@_streamed("st13_status_feed", "SELECT user_id, max_by(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY 1")
def st13(spark, sf_dir):
    """What a reader of the feed has seen last: each micro-batch appends the latest row of its keys."""
    scratch = _scratch(spark)
    feed = live.event_stream(spark, sf_dir, "events.parquet").select("user_id", "event_id", "event_type")
    live.each_batch(feed, lambda rows: rows.write.mode("append").parquet(f"{scratch}/out"), f"{scratch}/checkpoint", "user_id", "event_id")
    return live.latest_status(spark.read.parquet(f"{scratch}/out"))


@query("st14_retry_transitions", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'processing' ELSE 'ready_to_reprocess' END AS status, event_id % 3 <> 2 AS reset_counters, event_id % 3 = 1 AS delete_entities FROM events")
def st14(t):
    mode = F.element_at(F.array(*map(F.lit, ("start_from_beginning", "delete_entities_and_start_from_beginning", "start_from_last_processed_position"))), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.when(F.col("event_type") == "click", "processing").otherwise("failed")
    return t.events.select("event_id", jobs.retried(status, mode).alias("r")).select("event_id", "r.status", "r.reset_counters", "r.delete_entities")


@query("st15_retryable", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 90)")
def st15(t):
    staged = t.events.select("user_id", F.when((F.col("event_type") == "click") & (F.col("value") > 90), "extraction_error").otherwise("other").alias("kind"))
    return jobs.retryable(t.events.select("user_id").distinct(), staged, "user_id")


@query(
    "st_session_windows",
    """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n""",
)
def sessions(t):
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    made = events.groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("events"))
    return made.select("user_id", F.col("session_window.start").alias("start"), "events")
