"""Search and answering (R entries, L1-L3, and what they alone use) over the provided tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import evidence, fuzzy, text
from veritrail.operators import agent, modes, retrieval, search
from veritrail.operators.index import index_of
from veritrail.plans import substrate
from veritrail.plans.catalog import query

TERMS = ["therefore", "shesh", "eauon", "tionou", "license"]


def _bm25_sql(table="documents", key="doc_id", keep="source, text"):
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{k}" for k, t in enumerate(TERMS))
    df = ", ".join(f"(count(*) FILTER (t{k} > 0)) AS d{k}" for k in range(len(TERMS)))
    score = "0.0::DOUBLE" + "".join(f" + ln(1 + (n - d{k} + 0.5::DOUBLE) / (d{k} + 0.5::DOUBLE)) * t{k} * 2.2::DOUBLE / (t{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))" for k in range(len(TERMS)))
    hit = " OR ".join(f"t{k} > 0" for k in range(len(TERMS)))
    return rf"""w AS (SELECT {key}, {keep}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]{{2,}}') AS w FROM {table}),
    c AS (SELECT {key}, {keep}, len(w) AS l, {tf} FROM w), st AS (SELECT count(*) AS n, avg(l) AS mean, {df} FROM c),
    bm AS (SELECT {key}, {keep}, {score} AS score FROM c, st WHERE {hit})"""


_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 7)"


def _probe(t):
    return t.embeddings.where("vec_id = 7").select("embedding").first()[0]


@query("l1_r2_dense_top_k", f"WITH {_VEC} SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q ORDER BY round(list_cosine_similarity(e, q), 9) DESC, vec_id LIMIT 25")
def l1(t):
    return search.nearest_to(t.embeddings, _probe(t), 25, "vec_id", "embedding").select("vec_id", F.round("dense_score", 6).alias("score"))


@query("l2_bm25_top_k", f"WITH {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 40")
def l2(t):
    found = search.bm25(t.documents, TERMS, "doc_id", "text")
    return found.orderBy(F.desc("score"), "doc_id").limit(40).select("doc_id", F.round("score", 6).alias("score"))


@query("l2_index_top_k", f"WITH {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 40")
def l2i(t):
    """The same over a written index, whose blocks that can't reach the threshold are skipped."""
    found = index_of(t.documents, "doc_id", "text", "source").search(TERMS, 40).found
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("l2_index_report")
def l2r(t):
    """Blocks of the asked terms, and of those the ones that the search has read."""
    return index_of(t.documents, "doc_id", "text", "source").search(TERMS, 40).report


@query(
    "l2_bm25_many_queries",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_-]{2,}') AS w FROM documents), p AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM w), tf AS (SELECT doc_id, l, term, count(*) AS tf FROM p GROUP BY ALL),
    n AS (SELECT count(*) AS n, avg(l) AS mean FROM (SELECT DISTINCT doc_id, l FROM tf)), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_-]{2,}')[1:24]) AS term FROM benchmark)
    SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 4) AS score FROM q JOIN df USING (term) JOIN tf USING (term), n GROUP BY ALL""",
)
def l2b(t):
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.slice(search.terms_of(F.col("text")), 1, 24)).alias("term"))
    found = search.bm25_by_postings(search.postings(t.documents, "doc_id", "text"), asked, search.totals_of(t.documents, "doc_id", "text"))
    return found.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round("score", 4).alias("score"))


@query("f32_cosine", f"WITH {_VEC} SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS cosine, round((1 + list_cosine_similarity(e, q)) / 2, 6) AS unit_score FROM v, q")
def f32(t):
    c = search.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _probe(t)]))
    return t.embeddings.select("vec_id", F.round(c, 6).alias("cosine"), F.round((1 + c) / 2, 6).alias("unit_score"))


_R1 = rf"""WITH {_bm25_sql()},
    top AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 50),
    ok AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS v FROM top),
    rd AS (SELECT doc_id, source, score, lower(v) AS x FROM ok WHERE len(v) >= 20 AND len(v) - len(regexp_replace(v, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) <= 0.05 * len(v) AND len(v) - len(regexp_replace(v, '[\p{{L}}\p{{N}}]', '', 'g')) >= 0.2 * len(v)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k, min(score) OVER (PARTITION BY source) AS lo, max(score) OVER (PARTITION BY source) AS hi FROM rd),
    f AS (SELECT *, 1.0::DOUBLE / (60 + k) AS rrf, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN score <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS bm25_norm FROM rk ORDER BY rrf DESC, doc_id LIMIT 80),
    s AS (SELECT *, rrf / (SELECT max(rrf) FROM f) AS rrf_norm, list_filter(['license terms', 'shesh'], lambda z: CASE z WHEN 'shesh' THEN contains(x, 'shesh') ELSE contains(x, 'license') OR contains(x, 'terms') END) AS matched_slots FROM f),
    z AS (SELECT *, round_even(0.50::DOUBLE * rrf_norm + 0.15::DOUBLE * bm25_norm + 0.10::DOUBLE * least(1.0, len(matched_slots) / 2), 6) AS final FROM s),
    d AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY final DESC) <= 3), c2 AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY final DESC, doc_id) <= 8),
    l AS (SELECT * FROM c2 ORDER BY final DESC, doc_id LIMIT 20)
    SELECT row_number() OVER (ORDER BY final DESC, doc_id)::INT AS rank, doc_id AS chunk_id, doc_id AS document_id, source AS corpus_id, final AS score, round(rrf_norm, 6) AS rrf_norm, round(bm25_norm, 6) AS bm25_norm, 0.0::DOUBLE AS dense_norm, matched_slots FROM l"""


@query("r1_cross_corpus_search", _R1)
def r1(t):
    return retrieval.cross_corpus_search(t.documents)


@query("r1_indexed_search", _R1)
def r1i(t):
    """The same over a written index: only the folders of the query's terms and, of these, the blocks that can matter are read."""
    return retrieval.cross_corpus_search(t.documents, index=index_of(t.documents, "doc_id", "text", "source"))


_R1_HYBRID = rf"""WITH {_bm25_sql()}, {_VEC},
    near AS (SELECT vec_id, list_cosine_similarity(e, q) AS c FROM v, q ORDER BY c DESC, vec_id LIMIT 400),
    lists AS (SELECT 'bm25' AS ch, doc_id, source, text, score FROM bm UNION ALL SELECT 'dense', doc_id, source, text, c FROM documents JOIN near ON vec_id = doc_id),
    top AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY ch, source ORDER BY score DESC, doc_id) <= 50),
    ok AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS v FROM top),
    rd AS (SELECT ch, doc_id, source, score, lower(v) AS x FROM ok WHERE len(v) >= 20 AND len(v) - len(regexp_replace(v, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) <= 0.05 * len(v) AND len(v) - len(regexp_replace(v, '[\p{{L}}\p{{N}}]', '', 'g')) >= 0.2 * len(v)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY ch, source ORDER BY score DESC, doc_id) AS k, min(score) OVER (PARTITION BY ch, source) AS lo, max(score) OVER (PARTITION BY ch, source) AS hi FROM rd),
    nm AS (SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN score <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM rk),
    f AS (SELECT doc_id, any_value(source) AS source, any_value(x) AS x, sum(1.0::DOUBLE / (60 + k)) AS rrf, coalesce(max(CASE WHEN ch = 'bm25' THEN norm END), 0) AS bm25_norm, coalesce(max(CASE WHEN ch = 'dense' THEN norm END), 0) AS dense_norm
        FROM nm GROUP BY doc_id ORDER BY rrf DESC, doc_id LIMIT 80),
    s AS (SELECT *, rrf / (SELECT max(rrf) FROM f) AS rrf_norm, list_filter(['license terms', 'shesh'], lambda z: CASE z WHEN 'shesh' THEN contains(x, 'shesh') ELSE contains(x, 'license') OR contains(x, 'terms') END) AS matched_slots FROM f),
    z AS (SELECT *, round_even(0.50::DOUBLE * rrf_norm + 0.20::DOUBLE * dense_norm + 0.15::DOUBLE * bm25_norm + 0.10::DOUBLE * least(1.0, len(matched_slots) / 2), 6) AS final FROM s),
    c2 AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY source ORDER BY final DESC, doc_id) <= 8), l AS (SELECT * FROM c2 ORDER BY final DESC, doc_id LIMIT 20)
    SELECT row_number() OVER (ORDER BY final DESC, doc_id)::INT AS rank, doc_id AS chunk_id, doc_id AS document_id, source AS corpus_id, final AS score, round(rrf_norm, 6) AS rrf_norm, round(bm25_norm, 6) AS bm25_norm, round(dense_norm, 6) AS dense_norm, matched_slots FROM l"""


@query("r1_hybrid_search", _R1_HYBRID)
def r1b(t):
    """The same with a dense channel: vectors of the documents' ids."""
    dense = search.nearest_to(t.embeddings, _probe(t), 400, "vec_id", "embedding").select(F.col("vec_id").alias("chunk_id"), F.col("dense_score").alias("score"))
    return retrieval.cross_corpus_search(t.documents, dense=dense)


@query(
    "r3_source_evidence",
    r"""WITH m AS (SELECT source AS document_id, doc_id AS element_id, text, list_filter(['shesh', 'eauon', 'license'], lambda k: contains(lower(text), k)) AS matched FROM documents),
    b AS (SELECT m.*, coalesce(quality, 0) AS fact_count FROM m LEFT JOIN labels ON doc_id = element_id WHERE len(matched) >= 2 ORDER BY len(matched) DESC, fact_count DESC, element_id LIMIT 24)
    SELECT document_id, element_id, matched, fact_count::BIGINT AS fact_count, round(least(1.0, 0.45 + 0.4 * len(matched) / 3.0), 6)::DOUBLE AS confidence FROM b""",
)
def r3(t):
    elements = t.documents.select(F.col("source").alias("document_id"), F.col("doc_id").alias("element_id"), "text")
    facts = t.labels.where("quality = 1").select(F.col("doc_id").alias("element_id"), F.col("doc_id").alias("fact"))
    return retrieval.source_evidence(elements, ["shesh", "eauon", "license"], facts)


@query("r4_resolve_entity")
def r4(t):
    """The most similar name of at least 0.5; candidates are all names."""
    names = t.part.select("p_partkey", "p_name").withColumn("score", fuzzy.weighted_score(F.lit("smal ring widget"), F.col("p_name")) / 100)
    return names.where("score >= 0.5").orderBy(F.desc("score"), "p_partkey").limit(1).select("p_partkey", "p_name", F.round("score", 4).alias("score"))


@query(
    "r5_find_experiments",
    """WITH m AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_type), 'promo')), q AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_quantity) >= 45 AND min(l_quantity) <= 10)
    SELECT o_orderkey, o_orderkey % 100 / 100.0::DOUBLE AS confidence FROM orders WHERE o_orderkey IN (SELECT * FROM m) AND o_orderkey IN (SELECT * FROM q) AND o_orderpriority = '1-URGENT' ORDER BY confidence DESC, o_orderkey LIMIT 50""",
)
def r5(t, spark):
    materials = t.part.where(F.contains(F.lower("p_type"), F.lit("promo"))).select(F.col("p_partkey").alias("l_partkey"))
    with_material = t.lineitem.join(materials, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("id"), F.lit(1.0).alias("score"))
    ranges = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    wanted = spark.createDataFrame([("quantity", 45.0, 10.0, None)], "parameter string, min double, max double, unit string")
    met = retrieval.conditions_match(ranges.withColumns({"parameter": F.lit("quantity"), "unit": F.lit(None).cast("string")}), wanted)
    experiments = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100 / 100.0).alias("confidence"))
    return retrieval.find_experiments(experiments, [with_material], met).select(F.col("id").alias("o_orderkey"), "confidence")


@query(
    "r5_synthetic_gap",
    """SELECT 'missing_evidence' AS type, 'No verified evidence matches the requested combination' AS description, 'material=' || m || ', process=' || p AS filters, 'high' AS severity, 'tool_query' AS detected_by
    FROM (VALUES ('zzz', 'F'), ('ring', 'O'), ('ring', 'zzz')) v(m, p) WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_name), m) AND l_linestatus = p)""",
)
def r5b(t):
    """Three questions for a material and a status of line items; those that no line item answers are gaps."""
    out = None
    for material, process in (("zzz", "F"), ("ring", "O"), ("ring", "zzz")):
        parts = t.part.where(F.contains(F.lower("p_name"), F.lit(material))).select(F.col("p_partkey").alias("l_partkey"))
        gap = retrieval.found_or_gap(t.lineitem.where(F.col("l_linestatus") == process).join(parts, "l_partkey", "left_semi"), material=material, process=process, geography=[], year=None)
        out = gap if out is None else out.union(gap)
    return out


@query(
    "r6_find_technologies",
    """WITH c AS (SELECT doc_id, (contains(lower(text), 'shesh')::INT + contains(lower(text), 'license')::INT) / 2.0 AS p, contains(lower(text), 'eauon')::INT::DOUBLE AS x FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT doc_id, round(least(1.0, p + 0.15 * x), 6)::DOUBLE AS score, CASE WHEN x > 0 THEN 'met' ELSE 'unknown' END AS constraint_status FROM c WHERE p >= 0.3 ORDER BY score DESC, doc_id LIMIT 30""",
)
def r6(t):
    folded = F.lower("text")
    problem = text.how_many(folded, ("shesh", "license")) / 2.0
    constraint = text.how_many(folded, ("eauon",)).cast("double")
    claims = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    scored = claims.select(F.col("doc_id").alias("id"), problem.alias("problem"), constraint.alias("constraint"), F.lit(0.0).alias("context"))
    return retrieval.find_technologies(scored).withColumnRenamed("id", "doc_id")


@query("r7_evidence_pack", f"WITH {substrate.EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), a AS (SELECT dst FROM e WHERE src = 'c:7'), b AS (SELECT e.dst FROM e JOIN a ON e.src = a.dst), c AS (SELECT e.dst FROM e JOIN b ON e.src = b.dst) SELECT dst AS id FROM a UNION SELECT dst FROM b UNION SELECT dst FROM c")
def r7(t, spark):
    from veritrail.operators.graph import reachable

    return reachable(spark.createDataFrame([("c:7",)], "id string"), substrate.edges(t), 3).select("id")


@query("r8_contradiction_filter", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(r_name), 'a') AND contains(lower(n_name), '1') ORDER BY n_name DESC LIMIT 50")
def r8(t):
    j = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return retrieval.find_findings(j, {"r_name": "a", "n_name": "1"}, "n_name").select("n_name", "r_name")


@query("r9_find_experts", "SELECT s_suppkey, least(1.0, 0.2 + 0.1 * count(DISTINCT l_partkey))::DOUBLE AS score FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_quantity = 50 GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 3")
def r9(t):
    topic = F.when(F.col("l_quantity") == 50, 1.0).otherwise(0.0)
    works = t.lineitem.select(F.col("l_suppkey").alias("expert"), F.col("l_partkey").alias("work"), topic.alias("topic"), F.lit(None).cast("double").alias("process"))
    found = retrieval.find_experts(works, 3).withColumnRenamed("expert", "s_suppkey")
    return t.supplier.select("s_suppkey").join(found, "s_suppkey")


_HITS = f"WITH {_VEC}, h AS (SELECT vec_id, list_cosine_similarity(e, q) AS score FROM v, q WHERE list_cosine_similarity(e, q) >= 0.1 ORDER BY round(list_cosine_similarity(e, q), 9) DESC, vec_id LIMIT 50)"


def _hits(t, threshold=0.1, k=50):
    return search.nearest_to(t.embeddings, _probe(t), k, "vec_id", "embedding").where(F.col("dense_score") >= threshold).select(F.col("vec_id").alias("chunk_id"), F.col("dense_score").alias("score"))


@query(
    "a8_r11_vector_mode",
    _HITS + " SELECT source AS document_id, round(avg(score), 6) AS score, string_agg(text, chr(10) || '----' || chr(10) ORDER BY score DESC, doc_id) AS text, count(*)::INT AS n FROM h JOIN documents ON doc_id = vec_id GROUP BY 1",
)
def a8(t):
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text")
    return retrieval.by_document(_hits(t), chunks).select("document_id", F.round("score", 6).alias("score"), "text", "n")


@query(
    "r12_fulltext_mode",
    f"WITH {_bm25_sql()}, h AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 5) SELECT source AS document_id, round(avg(score), 6) AS score, count(*)::INT AS n FROM h JOIN documents USING (doc_id) GROUP BY 1",
)
def r12(t):
    hits = search.bm25(t.documents, TERMS, "doc_id", "text").orderBy(F.desc("score"), "doc_id").limit(5).withColumnRenamed("doc_id", "chunk_id")
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text")
    return retrieval.by_document(hits, chunks).select("document_id", F.round("score", 6).alias("score"), "n")


@query(
    "a9_r15_global_mode",
    _HITS + " SELECT round(avg(score), 6) AS score, string_agg(DISTINCT 'community ' || label, '; ' ORDER BY 'community ' || label) AS context FROM h JOIN embeddings USING (vec_id)",
)
def a9(t):
    names = F.concat(F.lit("community "), F.col("label").cast("string"))
    hit = _hits(t).join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), names.alias("name")), "chunk_id")
    return hit.agg(F.round(F.avg("score"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("context"))


@query(
    "r13_graph_vector_mode",
    f"""{_HITS}, s AS (SELECT l_partkey AS p, count(DISTINCT l_orderkey) AS n FROM h JOIN lineitem ON l_orderkey = vec_id GROUP BY 1 ORDER BY n DESC, p LIMIT 40)
    SELECT 'Material:' || p_name || ' (' || p_brand || ')' AS node, n FROM s JOIN part ON p_partkey = p""",
)
def r13(t):
    seeds = _hits(t).join(t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("p_partkey")), "chunk_id")
    top = seeds.groupBy("p_partkey").agg(F.count_distinct("chunk_id").alias("n")).orderBy(F.desc("n"), "p_partkey").limit(40)
    return t.part.join(top, "p_partkey").select(text.verbalized_node(F.lit("Material"), F.col("p_name"), F.col("p_brand")).alias("node"), "n")


@query("r14_entity_vector_mode", f"{_HITS}, k AS (SELECT * FROM h ORDER BY score DESC, vec_id LIMIT 10), c AS (SELECT l_orderkey AS chunk, count(DISTINCT l_partkey) AS freq FROM lineitem WHERE l_partkey IN (SELECT vec_id FROM k) GROUP BY 1 ORDER BY freq DESC, chunk LIMIT 3) SELECT chunk, freq FROM c")
def r14(t):
    seeds = _hits(t, k=10).select(F.col("chunk_id").alias("l_partkey"))
    return t.lineitem.join(seeds, "l_partkey", "left_semi").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.count_distinct("l_partkey").alias("freq")).orderBy(F.desc("freq"), "chunk").limit(3)


@query("r16_sql_over_views", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC LIMIT 3")
def r16(t, spark):
    """The generated-query mode becomes SQL over registered views."""
    t.documents.createOrReplaceTempView("vt_documents")
    return spark.sql("SELECT lang, count(*) AS n FROM vt_documents GROUP BY lang ORDER BY n DESC LIMIT 3")


@query("r17_compressor", f"WITH {_VEC} SELECT vec_id FROM v, q WHERE list_cosine_similarity(e, q) >= 0.10")
def r17(t):
    c = search.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _probe(t)]))
    return t.embeddings.where(c >= 0.10).select("vec_id")


@query(
    "r18_mode_guard",
    """WITH m AS (SELECT * FROM (VALUES ('vector', 5, 'chunk', false, true), ('fulltext', 5, 'chunk', true, false), ('entity_vector', 10, 'entity', false, false), ('graph_vector', 5, 'chunk', false, true), ('graph_vector_fulltext', 5, 'chunk', true, false),
    ('global_vector', 10, 'community', true, false)) v(mode, top_k, unit, hybrid, takes)), e AS (SELECT event_id, user_id % 3 AS n, ['vector', 'fulltext', 'entity_vector', 'graph_vector', 'graph_vector_fulltext', 'global_vector', 'unheard of'][event_id % 7 + 1] AS asked FROM events)
    SELECT event_id, mode, top_k, unit, hybrid, n > 0 AND NOT takes AS refused FROM e JOIN m ON mode = CASE WHEN asked = 'unheard of' THEN 'graph_vector_fulltext' ELSE asked END""",
)
def r18(t):
    """Every event as a request in one of the modes (or one that nobody knows), for no, one or two documents."""
    asked = F.get(F.array(*map(F.lit, ("vector", "fulltext", "entity_vector", "graph_vector", "graph_vector_fulltext", "global_vector", "unheard of"))), (F.col("event_id") % 7).cast("int"))
    return t.events.select("event_id", modes.guarded(asked, F.col("user_id") % 3).alias("g")).select("event_id", "g.*")


@query("r19_agentic_loop")
def r19(t, spark):
    """One question through the loop: its verdict, mode and evidence."""
    question = "Which license method treatment process at 25 °C"
    terms = search.terms_of(F.lit(question))

    def run(queries, strategy):
        share = F.size(F.array_intersect(search.terms_of(F.col("text")), terms)) / F.size(terms)
        best = t.documents.select("doc_id", "source", "text", share.alias("share")).where("share > 0").orderBy(F.desc("share"), "doc_id").limit(10)
        slots = text.supported_slots(agent.analyse(question).required, F.col("text"))
        rows = best.select("*", slots.alias("slots"), text.numeric_facts(F.col("text")).alias("facts"), evidence.is_direct(question, F.col("text"), strategy).alias("direct")).collect()
        return [agent.Item(str(r["doc_id"]), r["source"], r["text"], r["slots"], [f.asDict() for f in r["facts"]], confidence=float(r["share"]), direct=bool(r["direct"])) for r in rows]

    verdict, items, timeline = agent.evidence_loop(question, run)
    result = agent.answer(verdict, items, True)
    row = (verdict.action, verdict.score, result["mode"], float(result["confidence"]), verdict.missing, timeline, [i.label for i in items])
    return spark.createDataFrame([row], "action string, score int, mode string, confidence double, missing array<string>, timeline array<string>, labels array<string>")


@query(
    "r20_answer_cache_key",
    "SELECT item_id, sha256('answer:' || text || '|' || (SELECT max(doc_id)::VARCHAR || ':' || count(*) FROM documents) || '|policy-1') AS cache_key FROM benchmark",
)
def r20(t):
    from veritrail.functions.ids import cache_key

    version = t.documents.agg(F.concat_ws(":", F.max("doc_id").cast("string"), F.count("*").cast("string")).alias("version"))
    return t.benchmark.crossJoin(F.broadcast(version)).select("item_id", cache_key("answer", F.concat_ws("|", "text", "version", F.lit("policy-1"))).alias("cache_key"))


@query(
    "f25_r21_fact_recall",
    r"""WITH f AS (SELECT item_id, list_transform(regexp_extract_all(lower(text), '[a-zа-я0-9]+'), lambda t: {'t': t, 'p': CASE WHEN regexp_matches(t, '[а-я]') THEN t[1:5] ELSE t[1:4] END}) AS w FROM benchmark),
    a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zа-я0-9]+')) AS a FROM documents),
    m AS (SELECT item_id, doc_id, len(list_filter(w, lambda x: CASE WHEN regexp_matches(x.t, '^[0-9]+$') OR len(x.t) <= 3 THEN list_contains(a, x.t) ELSE len(list_filter(a, lambda v: starts_with(v, x.p))) > 0 END)) >= 0.7 * len(w) AS ok FROM f, a)
    SELECT item_id, count(*) FILTER (ok) AS documents FROM m GROUP BY 1""",
)
def f25(t):
    # all facts against all documents
    return retrieval.facts_found(t.benchmark, t.documents.select(F.col("text").alias("answer")), "item_id", "text", "answer").withColumnRenamed("found", "documents")


@query("a24_retrieval_audit", r"""WITH r AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY len(d.text), d.doc_id) AS k, contains(d.text, b.text) AS hit FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT round(avg((k <= 5)::INT), 6) AS recall_5, count(*) AS hits FROM r""")
def a24b(t):
    # exact containment, met on the passage's first words instead of all pairs
    words = lambda c: F.split(c, r"\s+")
    gold = t.benchmark.select("item_id", F.col("text").alias("gold"), F.array_join(F.slice(words("text"), 2, 3), " ").alias("k"))
    w = words("text")
    keys = t.documents.select("doc_id", "text", w.alias("w")).select("doc_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2)), lambda i: F.array_join(F.slice("w", i, 3), " ")))).alias("k"))
    met = keys.join(gold, "k").where(F.contains("text", F.col("gold"))).select("item_id", "doc_id", "text").distinct()
    k = F.row_number().over(Window.partitionBy("item_id").orderBy(F.length("text"), "doc_id"))
    return met.withColumn("k", k).agg(F.round(F.avg((F.col("k") <= 5).cast("int")), 6).alias("recall_5"), F.count("*").alias("hits"))


@query("r22_map_reduce", "WITH m AS (SELECT c_nationkey AS community, c_custkey AS point, c_acctbal AS score FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3) SELECT * FROM m ORDER BY score DESC, point LIMIT 20")
def r22(t):
    points = F.array(F.struct(F.col("c_custkey").alias("point"), F.col("c_acctbal").alias("score")))
    return retrieval.map_reduced(t.customer.withColumnRenamed("c_nationkey", "community"), points)


@query("r23_format_documents", "WITH d AS (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 4) SELECT string_agg('Document: ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY n_chars DESC, doc_id) AS context, list_sort(list(DISTINCT source)) AS sources FROM d")
def r23(t):
    d = t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(agent.document_cutoff("medium-context"))
    block = F.concat(F.lit("Document: "), "source", F.lit("\n"), "text")
    made = d.agg(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("n"), "doc_id", block.alias("b")))).alias("c"), F.array_sort(F.collect_set("source")).alias("sources"))
    return made.select(F.array_join(F.transform("c", lambda c: c["b"]), "\n\n").alias("context"), "sources")


@query(
    "f33_answer_mode",
    """WITH v AS (SELECT event_id, floor(value % 100)::INT AS score, event_id % 3 = 0 AS gates, event_id % 2 = 0 AS final FROM events), a AS (SELECT *, CASE WHEN gates AND score >= 80 THEN 'answer_full' WHEN NOT final THEN 'search_more' WHEN score >= 60 THEN 'answer_partial' ELSE 'no_data' END AS action FROM v),
    m AS (SELECT *, CASE WHEN action = 'answer_full' THEN 'full_answer' WHEN score >= 60 THEN 'partial_answer_with_gaps' ELSE 'NO_DIRECT_DATA' END AS mode FROM a)
    SELECT event_id, action, mode, round(CASE WHEN mode = 'partial_answer_with_gaps' THEN least(score / 100, 0.79) WHEN mode LIKE 'NO!_%' ESCAPE '!' THEN least(score / 100, 0.49) ELSE score / 100 END, 6)::DOUBLE AS confidence FROM m""",
)
def f33(t):
    v = t.events.select("event_id", F.floor(F.col("value") % 100).cast("int").alias("score"), (F.col("event_id") % 3 == 0).alias("gates"), (F.col("event_id") % 2 == 0).alias("final"))
    yes = F.lit(True)
    a = v.withColumn("action", evidence.action_of(F.col("score"), F.col("gates"), yes, yes, F.col("final")))
    m = a.withColumn("mode", evidence.answer_mode(F.col("action"), F.col("score") >= 60, F.lit(False), F.lit(1), F.lit(False)))
    return m.select("event_id", "action", "mode", F.round(evidence.capped_confidence(F.col("score"), F.col("mode")), 6).alias("confidence"))


@query("f34_citations", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'see [S1] and [источник не подтверждён]' ELSE 'see [S1] and [S2]' END AS answer, CASE WHEN doc_id % 2 = 0 THEN ['[S9x]'] ELSE [] END AS invalid FROM labels")
def f34(t):
    said = F.when(F.col("doc_id") % 2 == 0, "see [S1] and [S9x]").otherwise("see [S1] and [S2]")
    made = t.labels.select("doc_id", text.checked_citations(said, text.texts(("S1", "S2"))).alias("c"))
    return made.select("doc_id", "c.answer", "c.invalid")


@query("f35_neutral_wording", "SELECT doc_id, '> Основание оптимальности не подтверждено прямыми данными; варианты нельзя ранжировать окончательно.' || chr(10) || chr(10) || 'This is the best option' AS answer FROM labels")
def f35(t):
    return t.labels.select("doc_id", text.neutral_wording(F.lit("This is the best option"), F.lit(False)).alias("answer"))


@query("f45_final_scores", "SELECT doc_id, round_even((0.45 * 0.8 + 0.20 * 0.5 + 0.15 * 0.25 + 0.10 * 0.5 + 0.05 * (doc_id % 3) + 0.05 * 1.0) * 1.1, 6)::DOUBLE AS score FROM documents")
def f45(t):
    lit = F.lit
    score = text.reranked_score(lit(0.8), lit(0.5), lit(0.25), text.texts(("a",)), 2, (F.col("doc_id") % 3).cast("double"), lit(1.0), lit(1.1))
    return t.documents.select("doc_id", F.round(score, 6).alias("score"))


QUESTIONS = (
    "Compare world practice of leaching at 25 °C and optimal temperature", "gap in nickel experiments", "review of water treatment methods since 2019",
    "experts on slag", "plain question", "compare capital cost of domestic and foreign options over the last 10 years", "обзор методов за последние 5 лет, 300 мг/л",
)


TIME_SQL = agent.TIME.pattern.replace("\\w", "[\\p{L}\\p{N}_]")


def _asks(cues):
    known = {"numeric": f"(asks_number OR regexp_matches(text, '(?i){agent.UNIT.pattern}'))", "geography": "(asks_place AND asks_contrast)", "time": f"regexp_matches(lower(text), '{TIME_SQL}')"}
    return " AND ".join(known.get(c, f"asks_{c}") for c in sorted(cues))


_SAID = ", ".join("(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f") AS asks_{name}" for name, words in agent.CUES.items())
_KIND = lambda k: "CASE " + " ".join(f"WHEN {'true' if row[0] is None else 'asks_' + row[0]} THEN {row[k]!r}" for row in agent.KINDS) + " END"
_FIRST = "CASE " + " ".join(f"WHEN {'true' if row[0] is None else 'asks_' + row[0]} THEN {list(row[3])!r}" for row in agent.KINDS) + " END"
_MORE = "".join(f" || CASE WHEN {_asks(cues)} THEN {list(slots)!r} ELSE [] END" for cues, slots in agent.SLOTS)


@query(
    "f46_question_analysis",
    f"""WITH q AS (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1 - i, x FROM (VALUES {', '.join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))}) v(i, x)),
    s AS (SELECT doc_id, text, {_SAID} FROM q)
    SELECT doc_id, {_KIND(1)} AS intent, {_KIND(2)} AS answer_type, array_to_string(list_sort(list_distinct({_FIRST}{_MORE})), ',') AS required, {_asks(['numeric'])} AS "numeric", {_asks(['time'])} AS "time" FROM s""",
)
def f46(t, spark):
    asked = spark.createDataFrame([(-1 - i, q) for i, q in enumerate(QUESTIONS)], "doc_id long, text string")
    found = agent.analysed(t.documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(asked))
    return found.select("doc_id", "intent", "answer_type", F.array_join(F.array_sort("required"), ",").alias("required"), "numeric", "time")


@query("f47_segment_alignment")
def f47(t):
    from veritrail.operators.align import best_segments

    segments = t.conversations.select(F.col("conv_id").alias("video"), F.col("turn").alias("segment"), "text")
    chunks = segments.select("video", F.concat_ws("-", F.col("video").cast("string"), F.col("segment").cast("string")).alias("chunk_id"), "text")
    return best_segments(chunks, segments)


@query("x1_rule_extraction", rf"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{r"(?i)(\d+(?:[.,]\d+)?)\s*(" + text.NUMERIC_UNITS + ")?"}', 1)[1:20] AS v FROM documents) SELECT doc_id, len(v)::INT AS measurements FROM m WHERE len(v) > 0""")
def x1(t):
    from veritrail.operators.extract import measurements

    return measurements(t.documents, "doc_id", "text").groupBy("doc_id").agg(F.count("*").cast("int").alias("measurements"))


@query(
    "x6_post_processing",
    f"WITH {substrate.EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst) SELECT src AS id, count(*) AS degree FROM e GROUP BY 1",
)
def x6(t):
    """Two tasks, asked for in another order than that in which they run: edges made canonical, then degrees of nodes."""
    edges = substrate.edges(t)
    tasks = {
        "canonical": lambda nodes, edges: (nodes, edges.where("src <> dst").select("src", "dst").distinct()),
        "degrees": lambda nodes, edges: (nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id"), edges),
    }
    nodes, _ = modes.post_processed(edges.select(F.col("src").alias("id")).distinct(), edges, tasks, ["degrees", "canonical"])
    return nodes.select("id", "degree")


@query("f31_vector_literal", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.9g', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def f31(t):
    return t.embeddings.select("vec_id", text.vector_literal(F.col("embedding")).alias("literal"))


@query("x3_hashing_embedding")
def x3(t):
    v = search.hashing_embedding(F.col("text"), 16)
    return t.benchmark.select("item_id", v.alias("embedding"))


@query("x5_fuzzy_scores")
def x5(t):
    return t.supplier.select("s_suppkey", F.round(fuzzy.weighted_score(F.lit("supplier 00012"), F.col("s_name")), 4).alias("weighted"), F.round(fuzzy.partial_score(F.lit("plier"), F.col("s_name")), 4).alias("partial"))


@query("x9_rouge_l")
def x9(t):
    pairs = t.benchmark.join(t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer")), "item_id")
    return pairs.select("item_id", F.round(fuzzy.rouge_l(F.col("answer"), F.col("text")), 6).alias("rouge_l"))
