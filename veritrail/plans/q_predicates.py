"""Predicates and projections (P entries) over the provided tables."""

from pyspark.sql import functions as F

from veritrail.functions import evidence, text, urls
from veritrail.operators.relational import Filters
from veritrail.plans import substrate
from veritrail.plans.catalog import query


@query(
    "p1_metadata_filter",
    """SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE source IN ('src1', 'src2', 'src3') AND lang = 'en' AND n_chars >= 500 AND n_chars <= 4000
    AND source ILIKE '%RC%' AND coalesce(quality, 0) >= 0.5""",
)
def p1(t):
    filters = Filters(source_types=["src1", "src2", "src3"], language="en", year_from=500, year_to=4000, domain="RC", min_confidence=0.5,
                      columns={"source_type": "source", "language": "lang", "year": "n_chars", "domain": "source", "confidence": "quality"})
    return t.documents.join(t.labels, "doc_id", "left").where(filters.predicate()).select("doc_id")


@query("p2_corpus_membership", "SELECT doc_id, source FROM documents WHERE source IN ('src4', 'src5')")
def p2(t):
    return t.documents.where(F.col("source").isin("src4", "src5")).select("doc_id", "source")


@query("p4_searchable_elements", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND role IN ('user', 'assistant')")
def p4(t):
    return t.conversations.where((F.trim("text") != "") & F.col("role").isin("user", "assistant")).select("conv_id", "turn")


@query("p5_extraction_eligible", "SELECT conv_id, turn FROM conversations WHERE len(trim(text)) >= 40 AND role = 'user'")
def p5(t):
    return t.conversations.where((F.length(F.trim("text")) >= 40) & (F.col("role") == "user")).select("conv_id", "turn")


@query("p6_verified_only", f"WITH {substrate.NODES_SQL} SELECT id FROM nodes WHERE status IN ('F', 'O', 'BUILDING') OR label IN ('Nation', 'Region')")
def p6(t):
    return substrate.nodes(t).where(evidence.is_verified(F.col("status"), F.array("label"), ("F", "O", "BUILDING"), ("Nation", "Region"))).select("id")


@query("p7_label_predicates", f"WITH {substrate.NODES_SQL} SELECT label, count(*) AS n FROM nodes WHERE label NOT IN ('Customer', 'Experiment') GROUP BY label")
def p7(t):
    labels = F.array("label")
    return substrate.nodes(t).where(~F.arrays_overlap(labels, F.array(F.lit("Customer"), F.lit("Experiment")))).groupBy("label").agg(F.count("*").alias("n"))


@query("p8_property_projection", f"WITH {substrate.NODES_SQL} SELECT id, name FROM nodes WHERE label = 'Material'")
def p8(t):
    return substrate.nodes(t).where("label = 'Material'").select(F.struct("id", "name").alias("n")).select("n.id", "n.name")


@query("p9_key_regex_pick", "SELECT s_suppkey, 's_name' AS picked, s_name AS value FROM supplier")
def p9(t):
    props = F.create_map(F.lit("s_acctbal"), F.col("s_acctbal").cast("string"), F.lit("s_name"), F.col("s_name"))
    picked = F.get(F.filter(F.map_keys(props), lambda k: k.rlike("(name|title|id|description)$")), 0)
    return t.supplier.select("s_suppkey", picked.alias("picked"), F.try_element_at(props, picked).alias("value"))


@query("p10_token_containment", "SELECT doc_id FROM documents WHERE contains(lower(text), 'shesh') OR contains(lower(text), 'eauon')")
def p10(t):
    return t.documents.where(F.exists(text.texts(("shesh", "eauon")), lambda k: F.contains(F.lower("text"), k))).select("doc_id")


@query(
    "p11_minimum_match",
    """WITH m AS (SELECT doc_id, len(list_filter(['shesh', 'eauon', 'tionou', 'nthing'], lambda k: contains(lower(text), k))) AS n FROM documents)
    SELECT doc_id, n::INT AS matched FROM m WHERE n >= 2""",
)
def p11(t):
    return t.documents.select("doc_id", evidence.matched_tokens(F.col("text"), ["shesh", "eauon", "tionou", "nthing"]).alias("m")).where(evidence.enough(F.col("m"), 4)).select("doc_id", F.size("m").alias("matched"))


@query("p13_year_filter_fails_closed", "SELECT o_orderkey FROM orders WHERE false")
def p13(t):
    """strict_reference: any year range removes every experiment (the default honours the range)."""
    return t.orders.where(evidence.year_filter(F.year("o_orderdate"), 1995, None, strict_reference=True)).select("o_orderkey")


@query("p13_year_filter", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1995")
def p13b(t):
    return t.orders.where(evidence.year_filter(F.year("o_orderdate"), 1995, None)).select("o_orderkey")


@query("p16_direct_evidence", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{a}')" for a in ("thereti", "ouining", "over", "shesh")))
def p16(t):
    return t.documents.where(evidence.is_direct("Compare thereti ouining over Shesh process", F.col("text"), "broad")).select("doc_id")


@query("p17_claimable_jobs", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND event_id % 5 < 3 AND (event_id % 7 = 0 OR ts < TIMESTAMP '2024-01-10')")
def p17(t):
    jobs = t.events.select("event_id", F.col("event_type").alias("stage"), (F.col("event_id") % 5).alias("attempts"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("lease_until"))
    return jobs.where(evidence.claimable(("click", "view"), 3, F.lit("2024-01-10").cast("timestamp_ntz"))).select("event_id")


@query(
    "p18_domain_allow_list",
    r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h FROM pages)
    SELECT page_id, h AS host FROM h WHERE h = 'example.com' OR ends_with(h, '.example.com') OR h = 'm.example.org' OR ends_with(h, '.m.example.org')""",
)
def p18(t):
    return t.pages.where(urls.allowed_domain(F.col("url"), ("example.com", "m.example.org"))).select("page_id", urls.host(F.col("url")).alias("host"))


@query("p19_unconnected_entities", "SELECT 'c:' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def p19(t):
    from veritrail.operators.graph import unconnected

    nodes = substrate.nodes(t).where("label in ('Customer', 'Experiment')")
    return unconnected(nodes, substrate.edges(t).where("rel = 'PLACED'")).select("id")


@query("p20_review_queue", f"WITH {substrate.NODES_SQL} SELECT id, status FROM nodes WHERE label = 'Experiment' AND status = 'P' ORDER BY id DESC LIMIT 100")
def p20(t):
    found = substrate.nodes(t).where("label = 'Experiment'").withColumn("needs_review", F.lit(False))
    return evidence.review_queue(found, staging=F.lit(False), raw_status="P", order=F.desc("id"), limit=100).select("id", "status")


@query("p21_completed_documents", "SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0")
def p21(t):
    return t.documents.join(t.labels, "doc_id").where("quality = 1 and toxic = 0").select("doc_id", "source")


@query(
    "p22_schema_allowed_triples",
    f"""WITH {substrate.NODES_SQL}, {substrate.EDGES_SQL} SELECT a.label AS src_label, e.rel, b.label AS dst_label, count(*) AS n FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id
    WHERE (a.label, e.rel, b.label) IN (('Customer', 'PLACED', 'Experiment'), ('Nation', 'PARENT_COMMUNITY', 'Region')) GROUP BY ALL""",
)
def p22(t):
    from veritrail.operators.graph import allowed_triples, labelled_edges

    allowed = evidence.parse_triples("Customer,PLACED,Experiment,Nation,PARENT_COMMUNITY,Region", ["Customer", "Experiment", "Nation", "Region"])
    relations = sorted({rel for _, rel, _ in allowed})
    kept = allowed_triples(labelled_edges(substrate.nodes(t), substrate.edges(t).where(F.col("rel").isin(relations))), allowed)
    return kept.groupBy("src_label", "rel", "dst_label").agg(F.count("*").alias("n"))


@query(
    "p23_scrub_nodes",
    "SELECT trim(replace(p_name, '`', '')) AS id, trim(p_type) AS type FROM part WHERE trim(p_name) <> '' AND p_partkey % 10 <> 0",
)
def p23(t):
    from veritrail.operators.graph import scrubbed_nodes

    raw = t.part.select(F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.concat(F.lit(" `"), F.col("p_name"), F.lit("` "))).alias("id"), F.concat(F.lit("`"), F.col("p_type"), F.lit("`")).alias("type"))
    return scrubbed_nodes(raw)


@query(
    "p24_evidence_without_vector",
    "SELECT doc_id FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def p24(t):
    facts = t.labels.where("quality = 1").select("doc_id")
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    return t.documents.where(F.trim("text") != "").join(facts, "doc_id", "left_semi").join(vectors, "doc_id", "left_anti").select("doc_id")
