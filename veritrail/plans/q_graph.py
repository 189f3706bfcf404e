"""Graph operators (G entries, and the joins and aggregates that only graphs use) on the star schema read as a graph."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import ids
from veritrail.operators import counters, graph, names, quality
from veritrail.operators.retrieval import pathways
from veritrail.plans import substrate
from veritrail.plans.catalog import query

N, E = substrate.NODES_SQL, substrate.EDGES_SQL


def _uuid5(value):
    """The stable id of a SQL expression."""
    d = f"sha1(unhex('{ids.NAMESPACE.replace('-', '')}') || encode({value}))"
    variant = f"lower(printf('%02x', ('0x' || ({d})[17:18])::INT & 63 | 128))"
    return f"({d})[1:8] || '-' || ({d})[9:12] || '-5' || ({d})[14:16] || '-' || {variant} || ({d})[19:20] || '-' || ({d})[21:32]"


_PLACED = "e AS (SELECT src, dst FROM edges WHERE rel IN ('PLACED', 'USES_EQUIPMENT'))"


def _orders(t):
    return substrate.edges(t).where("rel in ('PLACED', 'USES_EQUIPMENT')")


@query(
    "j12_banded_expansion",
    f"""WITH RECURSIVE {E}, {_PLACED}, s AS (SELECT 'c:' || c_custkey AS id, c_custkey % 11 / 10.0 AS score FROM customer),
    sym AS (SELECT src AS a, dst AS b, src || '>' || dst AS k FROM e UNION ALL SELECT dst, src, src || '>' || dst FROM e),
    one AS (SELECT id AS seed, score, b, k, 1 AS hops FROM s JOIN sym ON a = id WHERE score >= 0.3),
    two AS (SELECT seed, score, sym.b, sym.k, 2 FROM one JOIN sym ON sym.a = one.b AND sym.k <> one.k WHERE score > 0.9),
    r AS (SELECT seed, score, b, min(hops) AS hops FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE b <> seed GROUP BY ALL)
    SELECT seed, b, hops::INT AS hops FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, b) AS n FROM r) WHERE n <= CASE WHEN score > 0.9 THEN 40 ELSE 20 END""",
)
def j12(t):
    seeds = t.customer.select(substrate.key("c", "c_custkey").alias("id"), (F.col("c_custkey") % 11 / 10.0).alias("score"))
    return graph.banded_expansion(seeds, _orders(t))


@query(
    "j13_g11_similar_edges",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.e, b.e), 12) AS c FROM v a, v b),
    k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS n FROM s QUALIFY n <= 6),
    f AS (SELECT src, dst, (1 + c) / 2 AS score, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS m FROM k WHERE src <> dst AND (1 + c) / 2 >= 0.62)
    SELECT src, dst, round(score, 6) AS score FROM f WHERE m <= 5""",
)
def j13(t):
    return graph.similar_edges(t.embeddings, "vec_id", "embedding", threshold=0.62).select("src", "dst", F.round("score", 6).alias("score"))


@query("j16_stem_match", "WITH w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_type), '[a-zа-яё0-9]+')) AS w FROM part) SELECT DISTINCT p_partkey FROM w WHERE len(w) >= 3 AND (starts_with(CASE WHEN len(w) <= 4 THEN w WHEN len(w) <= 7 THEN w[1:len(w) - 1] ELSE w[1:6] END, 'promot') OR starts_with('promot', CASE WHEN len(w) <= 4 THEN w WHEN len(w) <= 7 THEN w[1:len(w) - 1] ELSE w[1:6] END))")
def j16(t):
    from veritrail.functions.text import text_match_score

    return t.part.where(text_match_score(F.lit("promotion"), F.col("p_type")) >= 0.45).select("p_partkey")


@query(
    "j17_duplicate_nodes",
    """WITH n AS (SELECT 's:' || s_suppkey AS id, 'n' || s_nationkey AS label, lower(s_name) AS name FROM supplier)
    SELECT a.id, list_sort(list(DISTINCT b.id)) AS similar FROM n a JOIN n b ON a.label = b.label AND a.id <> b.id
    WHERE contains(a.name, b.name) OR contains(b.name, a.name) OR (len(a.name) > 5 AND levenshtein(a.name, b.name) < 3) GROUP BY 1""",
)
def j17(t):
    return names.duplicate_groups(t.supplier.select(substrate.key("s", "s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("label"), F.col("s_name").alias("name")))


@query(
    "j18_g15_r10_pathways",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 100 / 100.0 AS c, CASE WHEN o_orderkey % 9 = 0 THEN 'conflicting' END AS st FROM orders),
    f AS (SELECT * FROM o ORDER BY c DESC, 'o:' || o_orderkey LIMIT 500),
    m AS (SELECT DISTINCT 'o:' || l_orderkey AS k, 'p:' || l_partkey AS id FROM lineitem), e AS (SELECT DISTINCT 'o:' || l_orderkey AS k, 's:' || l_suppkey AS id FROM lineitem),
    r AS (SELECT DISTINCT 'o:' || l_orderkey AS k, 'm:' || l_orderkey || '-' || l_linenumber AS id, l_discount * 10 AS c FROM lineitem WHERE l_tax > 0.02),
    x AS (SELECT 'o:' || o_orderkey AS experiment, o.c AS oc, st, m.id AS material, p.id AS process, e.id AS equipment, r.id AS result, r.c AS rc FROM f o LEFT JOIN m ON m.k = 'o:' || o_orderkey
      LEFT JOIN (SELECT 'o:' || o_orderkey AS k, o_orderpriority AS id FROM orders) p ON p.k = 'o:' || o_orderkey LEFT JOIN e ON e.k = 'o:' || o_orderkey LEFT JOIN r ON r.k = 'o:' || o_orderkey
      ORDER BY oc DESC, experiment, material NULLS FIRST, process NULLS FIRST, equipment NULLS FIRST, result NULLS FIRST LIMIT 200)
    SELECT experiment, material, process, equipment, result, list_filter([CASE WHEN material IS NULL THEN 'material' END, CASE WHEN process IS NULL THEN 'process' END, CASE WHEN equipment IS NULL THEN 'equipment' END, CASE WHEN result IS NULL THEN 'result' END], lambda v: v IS NOT NULL) AS missing,
    material IS NOT NULL AND process IS NOT NULL AND equipment IS NOT NULL AND result IS NOT NULL AS complete, round(coalesce(least(oc, rc), 0.5), 3)::DOUBLE AS confidence,
    CASE WHEN st = 'conflicting' THEN 'conflicting' WHEN coalesce(least(oc, rc), 0.5) < 0.65 THEN 'low_confidence' ELSE 'verified' END AS status FROM x""",
)
def j18(t):
    null, none = F.lit(None).cast("double"), F.lit(None).cast("string")
    o = t.orders
    experiments = o.select(substrate.key("o", "o_orderkey").alias("id"), (F.col("o_orderkey") % 100 / 100.0).alias("confidence"), F.when(F.col("o_orderkey") % 9 == 0, "conflicting").alias("status"))
    branch = lambda df, key, col, c: df.select(key.alias("experiment"), col.alias("id"), c.alias("confidence"), none.alias("status"))
    of = substrate.key("o", "l_orderkey")
    item = F.concat_ws("-", F.concat(F.lit("m:"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"))
    return pathways(
        experiments,
        {
            "material": branch(t.lineitem, of, substrate.key("p", "l_partkey"), null),
            "process": branch(o, substrate.key("o", "o_orderkey"), F.col("o_orderpriority"), null),
            "equipment": branch(t.lineitem, of, substrate.key("s", "l_suppkey"), null),
            "result": branch(t.lineitem.where("l_tax > 0.02"), of, item, F.col("l_discount") * 10),
        },
        limit=200,
    )


@query("j20_correlated_counts", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def j20(t):
    count = lambda df, key, name: df.groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    j = t.nation.join(count(t.customer, "c_nationkey", "customers"), "n_nationkey", "left").join(count(t.supplier, "s_nationkey", "suppliers"), "n_nationkey", "left")
    return j.select("n_name", zero("customers"), zero("suppliers"))


@query("j21_claim_jobs", "WITH c AS (SELECT event_id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 20) SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM c) THEN 'worker-1' END AS owner FROM events WHERE event_type = 'view'")
def j21(t):
    from veritrail.streaming.jobs import claimed

    jobs = t.events.where("event_type = 'view'").select("event_id", "ts")
    return claimed(jobs, F.lit(True), ["ts", "event_id"], 20, "worker-1", "event_id").select("event_id", "owner")


@query("a16_quality_metrics", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0)) AS facts_without_evidence, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)) AS orphan_facts, false AS passed")
def a16(t):
    facts = t.lineitem.select(F.col("l_partkey").alias("id"))
    evidence = t.part.where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("id"))
    connected = t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("id"))
    return quality.metrics({
        "documents": (t.documents, None), "facts_without_evidence": (facts, evidence), "orphan_facts": (t.part.select(F.col("p_partkey").alias("id")), connected),
    }, must_be_zero=["facts_without_evidence", "orphan_facts"])


@query("a17_document_coverage", "SELECT c_custkey AS document, c_mktsegment AS category, count(DISTINCT o_orderkey) AS elements, count(DISTINCT CASE WHEN l_quantity > 45 THEN l_orderkey * 10 + l_linenumber END) AS facts FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def a17(t):
    elements = t.orders.select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("element"))
    facts = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("element"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact"))
    docs = t.customer.select(F.col("c_custkey").alias("document"), F.col("c_mktsegment").alias("category"))
    return quality.document_coverage(docs, elements, facts)


@query("a18_readiness", f"WITH {E}, u AS (SELECT src AS a FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT a, count(*) AS n FROM u GROUP BY 1), r AS (SELECT CASE a[1:2] WHEN 'c:' THEN 'Customer' WHEN 'p:' THEN 'Material' WHEN 's:' THEN 'Equipment' ELSE 'other' END AS kind, a AS id, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, a) AS rk FROM d) SELECT kind, id, n AS degree, rk::INT AS rank FROM r WHERE rk <= 8 AND kind <> 'other'")
def a18(t):
    n = substrate.nodes(t).where("label in ('Customer', 'Material', 'Equipment')").select("id", F.col("label").alias("kind"))
    return quality.top_degrees(n, substrate.edges(t), 8)


_READY_LABELS = {"documents": "Customer", "experiments": "Experiment", "materials": "Material", "equipment": "Equipment", "nations": "Nation", "regions": "Region", "claims": "Claim", "knowledge_gaps": "KnowledgeGap"}
_READY_COUNTS = " UNION ALL ".join(f"SELECT 'counter', '{name}', NULL, (SELECT count(*) FROM nodes WHERE label = '{label}')" for name, label in _READY_LABELS.items())


@query(
    "a18_readiness_report",
    f"""WITH {substrate.NODES_SQL}, {E}, d AS (SELECT a, count(*) AS n FROM (SELECT src AS a FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
    r AS (SELECT label, name, row_number() OVER (PARTITION BY label ORDER BY coalesce(n, 0) DESC, id) AS k, coalesce(n, 0) AS n FROM nodes LEFT JOIN d ON a = id WHERE label IN ('Material', 'Equipment', 'Customer', 'Nation') QUALIFY k <= 8)
    SELECT 'counter' AS section, 'nodes' AS name, NULL::INT AS rank, (SELECT count(*) FROM nodes) AS value UNION ALL SELECT 'counter', 'review_items', NULL, (SELECT count(*) FROM nodes WHERE status IN ('O', 'P')) UNION ALL {_READY_COUNTS}
    UNION ALL SELECT 'counter', 'relationships', NULL, (SELECT count(*) FROM edges) UNION ALL SELECT 'coverage', coalesce(status, 'unknown'), NULL, count(*) FROM nodes WHERE label = 'Customer' GROUP BY 2 UNION ALL SELECT 'top', label || ':' || name, k::INT, n FROM r""",
)
def a18b(t):
    nodes = substrate.nodes(t).withColumn("category", F.col("status"))
    return counters.readiness(nodes, substrate.edges(t), _READY_LABELS, ["Material", "Equipment", "Customer", "Nation"], F.col("status").isin("O", "P"), document_label="Customer")


@query("g1_projection", f"WITH {E} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM edges WHERE src <> dst GROUP BY ALL")
def g1(t):
    return graph.projection(substrate.edges(t))


def _suppliers(t):
    """Suppliers linked by materials of the same orders: a weighted graph over all orders."""
    met = graph.shared_neighbours(t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("met")))
    a, b = (F.concat(F.lit("s"), F.col(c).cast("string")) for c in ("a", "b"))
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col("shared").alias("weight"))


@query("g2_communities")
def g2(t):
    return graph.communities(_suppliers(t), levels=2, rounds=4)


@query("g2_label_propagation")
def g2b(t):
    return graph.label_communities(_suppliers(t), rounds=4)


@query("g3_community_levels", "SELECT 'c:' || c_custkey AS child, 'IN_COMMUNITY' AS rel, '0-' || c_nationkey AS parent FROM customer UNION SELECT '0-' || c_nationkey, 'PARENT_COMMUNITY', '1-' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def g3(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return graph.community_levels(j.select(substrate.key("c", "c_custkey").alias("id"), F.array("c_nationkey", "n_regionkey").alias("communities")))


@query("g4_induced_subgraph", "SELECT n_regionkey AS community, 'n:' || a.n_nationkey AS src, 'NEAR' AS rel, 'n:' || b AS dst FROM nation a JOIN (SELECT n_nationkey AS b, n_regionkey AS rb FROM nation) ON b = a.n_nationkey + 5 AND rb = a.n_regionkey")
def g4(t):
    member = t.nation.select(substrate.key("n", "n_nationkey").alias("id"), F.col("n_regionkey").alias("community"))
    edges = t.nation.select(substrate.key("n", "n_nationkey").alias("src"), F.lit("NEAR").alias("rel"), F.concat(F.lit("n:"), (F.col("n_nationkey") + 5).cast("string")).alias("dst"))
    return graph.induced(edges, member)


@query(
    "g5_community_summary",
    "WITH m AS (SELECT c_nationkey AS community, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS n, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer) SELECT community, max(size) AS size, string_agg(name, ', ' ORDER BY n) AS summary FROM m WHERE n <= 5 GROUP BY 1",
)
def g5(t):
    return quality.community_summaries(t.customer.select(F.col("c_nationkey").alias("community"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("weight")), 5)


@query(
    "g5_parent_summaries",
    """WITH RECURSIVE m AS (SELECT 'n:' || c_nationkey AS community, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS n FROM customer),
    up AS (SELECT 'n:' || n_nationkey AS community, 'r:' || n_regionkey AS parent FROM nation UNION SELECT 'r:' || r_regionkey, CASE WHEN r_regionkey < 2 THEN 'h:0' ELSE 'h:1' END FROM region UNION VALUES ('h:0', 'world'), ('h:1', 'world')),
    f AS (SELECT community, 0 AS level, 0::BIGINT AS children, string_agg(name, ', ' ORDER BY n) AS summary FROM m WHERE n <= 3 GROUP BY 1
      UNION ALL SELECT parent, max(level) + 1, count(*), left(string_agg('Summary ' || k || ': ' || summary, ' ' ORDER BY k), 400) FROM (SELECT parent, level, summary, row_number() OVER (PARTITION BY parent ORDER BY community) AS k FROM f JOIN up USING (community)) GROUP BY parent)
    SELECT community, level::INT AS level, children, summary FROM f""",
)
def g5b(t):
    """Summaries of nations, of regions from these, of halves of the world, and of the world."""
    leaves = quality.community_summaries(t.customer.select(substrate.key("n", "c_nationkey").alias("community"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("weight")), 3)
    half = F.when(F.col("r_regionkey") < 2, "h:0").otherwise("h:1")
    parents = t.nation.select(substrate.key("n", "n_nationkey").alias("child"), substrate.key("r", "n_regionkey").alias("parent")).union(t.region.select(substrate.key("r", "r_regionkey"), half)).union(t.region.select(half, F.lit("world")).distinct())
    return counters.parent_summaries(leaves, parents, 3)


@query(
    "g6_components",
    f"""WITH RECURSIVE {E}, e AS (SELECT src, dst FROM edges WHERE rel = 'PLACED'), sym AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    reach AS (SELECT a AS id, a AS r FROM sym UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.id WHERE reach.r <= sym.b)
    SELECT component, count(*) AS size FROM (SELECT id, min(r) AS component FROM reach GROUP BY id) GROUP BY 1""",
)
def g6(t):
    e = substrate.edges(t).where("rel = 'PLACED'").select("src", "dst")
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return graph.components(nodes, e).groupBy("component").agg(F.count("*").alias("size"))


@query("g7_neighbours", f"WITH {E}, u AS (SELECT src AS a, rel, dst AS b FROM edges UNION SELECT dst, rel, src FROM edges) SELECT * FROM u WHERE a IN ('o:33', 's:5')")
def g7(t):
    return graph.neighbours(substrate.edges(t), ["o:33", "s:5"])


@query(
    "g8_document_view",
    """WITH d AS (SELECT c_custkey FROM customer WHERE c_custkey IN (7, 11)), c AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT * FROM d) QUALIFY n <= 50),
    e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM c))
    SELECT 'c:' || o_custkey AS src, 'PLACED' AS rel, 'o:' || o_orderkey AS dst FROM c UNION SELECT 'o:' || l_orderkey, 'USES_MATERIAL', 'p:' || l_partkey FROM e
    UNION SELECT 'o:' || a.o_orderkey, 'NEXT_CHUNK', 'o:' || b.o_orderkey FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND b.n = a.n + 1""",
)
def g8(t):
    return quality.document_view(
        t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("chunk")), t.lineitem.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity")), [7, 11], 50
    )


@query("g9_context_lookup", "SELECT DISTINCT 'p:' || l_partkey AS entity, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (1, 33, 66)")
def g9(t):
    hit = t.lineitem.where(F.col("l_orderkey").isin(1, 33, 66)).select(F.col("l_partkey").alias("p_partkey")).distinct()
    return t.part.join(hit, "p_partkey", "left_semi").select(substrate.key("p", "p_partkey").alias("entity"), F.col("p_name").alias("name"))


@query("g10_chunk_paging", "SELECT conv_id, turn, text FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 10")
def g10(t):
    from veritrail.operators.relational import page

    return page(t.conversations.where("conv_id = 3").select("conv_id", "turn", "text"), [F.col("turn")], 1)


@query(
    "g12_merge_duplicates",
    f"""WITH {E}, e AS (SELECT * FROM edges WHERE rel IN ('USES_EQUIPMENT', 'IN_COMMUNITY')), m AS (SELECT 's:' || s_suppkey AS d, 's:' || (s_suppkey - 1) AS k FROM supplier WHERE s_suppkey % 10 = 5),
    r AS (SELECT DISTINCT coalesce(a.k, src) AS src, rel, coalesce(b.k, dst) AS dst FROM e LEFT JOIN m a ON a.d = src LEFT JOIN m b ON b.d = dst) SELECT rel, count(*) AS n FROM r WHERE src <> dst GROUP BY 1""",
)
def g12(t):
    mapping = t.supplier.where("s_suppkey % 10 = 5").select(substrate.key("s", "s_suppkey").alias("duplicate"), F.concat(F.lit("s:"), (F.col("s_suppkey") - 1).cast("string")).alias("keep"))
    _, edges = graph.merged(substrate.nodes(t), substrate.every_edge(t).where("rel in ('USES_EQUIPMENT', 'IN_COMMUNITY')"), mapping)
    return edges.groupBy("rel").agg(F.count("*").alias("n"))


@query("g13_delete_documents", "SELECT DISTINCT l_partkey AS entity FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 10 = 0)")
def g13(t):
    docs = t.orders.select((F.col("o_orderkey") % 10).alias("doc"), F.col("o_orderkey").alias("chunk"))
    mentions = t.lineitem.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))
    return graph.without_documents(docs, mentions, list(range(1, 10)))[2]


@query("g14_resume_position", "SELECT conv_id, min(turn) AS position FROM conversations WHERE len(text) > 100 GROUP BY 1")
def g14(t):
    return t.conversations.where(F.length("text") > 100).groupBy("conv_id").agg(F.min("turn").alias("position"))


@query(
    "g16_contradictions",
    """WITH c AS (SELECT doc_id, source, lower(text) AS x FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT a.doc_id AS a, b.doc_id AS b, 'contradiction_' || a.doc_id || ':' || b.doc_id AS k FROM c a JOIN c b ON a.source = b.source AND a.doc_id < b.doc_id
    WHERE (contains(a.x, 'shesh') AND contains(b.x, 'eauon')) OR (contains(b.x, 'shesh') AND contains(a.x, 'eauon'))""",
)
def g16(t):
    claims = t.documents.join(t.labels.where("quality = 1"), "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), "text")
    found = quality.contradictions(claims, ((("shesh",), ("eauon",)),))
    return found.select("a", "b", F.concat(F.lit("contradiction_"), F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"))).alias("k"))


@query("g16_similar_cases", "WITH p AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS k FROM lineitem) SELECT a.e AS a, b.e AS b, list_sort(list(a.k)) AS shared, 0.7::DOUBLE AS score FROM p a JOIN p b ON a.k = b.k AND a.e < b.e GROUP BY a.e, b.e")
def g16b(t):
    return quality.similar_cases(t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("shared")))


@query("g16_risks", "SELECT l_orderkey, 'late' AS risk FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 UNION ALL SELECT l_orderkey, 'returned' FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50")
def g16c(t):
    claims = t.lineitem.where("l_returnflag = 'R' and l_quantity = 50").select(F.col("l_orderkey").alias("id"), F.array(F.lit("late"), F.lit("returned")).alias("limitations"))
    return quality.risks(claims).select(F.col("id").alias("l_orderkey"), F.col("description").alias("risk"))


_GAPS = [("known", ["the"]), ("unknown", ["zzqx"]), ("also unknown", ["qqq", "xzxz"]), ("licensing", ["zzqx", "license"]), ("untold", ["no such words"])]
_GAP_ROWS = ", ".join(f"('{name}', '{term}')" for name, terms in _GAPS for term in terms)


@query("g16_knowledge_gaps", f"WITH p(gap, term) AS (VALUES {_GAP_ROWS}) SELECT gap, 'high' AS severity FROM p GROUP BY gap HAVING NOT bool_or(EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), term)))")
def g16d(t):
    return quality.knowledge_gaps(t.documents.select("text"), _GAPS).select("gap", "severity")


@query(
    "g17_subclass_closure",
    r"""WITH RECURSIVE p AS (SELECT DISTINCT regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g') AS child, regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g') AS parent FROM part UNION SELECT DISTINCT regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), 'Material' FROM part UNION VALUES ('Material', 'Entity')),
    c AS (SELECT child, parent AS ancestor, 1 AS distance FROM p UNION SELECT c.child, p.parent, distance + 1 FROM c JOIN p ON p.child = c.ancestor) SELECT child, ancestor, distance::INT AS distance FROM c""",
)
def g17(t):
    """An ontology in Turtle made of all parts: brands are kinds of their types, these of materials."""
    from veritrail.sources.ontology import subclass_lines

    name = lambda c: F.concat(F.lit("m:"), F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))
    stated = lambda child, parent: t.part.select(F.concat(child, F.lit(" a owl:Class ; rdfs:subClassOf "), parent, F.lit(" .")).alias("value"))
    lines = stated(name("p_brand"), name("p_type")).union(stated(name("p_type"), F.lit("m:Material"))).union(stated(F.lit("m:Material"), F.lit("m:Entity"))).distinct()
    return graph.tree_closure(subclass_lines(lines), 4).distinct()


@query(
    "g17_shape_violations",
    """WITH m AS (SELECT 'm:' || l_orderkey || '-' || l_linenumber AS id, * FROM lineitem)
    SELECT id, 'HAS_UNIT' AS path FROM m WHERE id NOT IN (SELECT id FROM m WHERE l_quantity <> 7) UNION ALL SELECT id, 'value' FROM m WHERE l_discount = 0 AND l_tax = 0""",
)
def g17b(t):
    items = t.lineitem
    mid = F.concat_ws("-", F.concat(F.lit("m:"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"))
    nodes = items.select(mid.alias("id"), F.lit("Measurement").alias("label"), F.nullif("l_discount", F.lit(0.0)).alias("value_min"), F.nullif("l_tax", F.lit(0.0)).alias("value_max"))
    units = items.where("l_quantity <> 7").select(mid.alias("src"), F.lit("HAS_UNIT").alias("rel"), F.lit("u").alias("dst"))
    return quality.violations(nodes, units, [quality.Shape("Measurement", relations=("HAS_UNIT",), any_of=("value_min", "value_max"))]).select("id", "path")


@query("g18_review", "WITH d AS (SELECT user_id, event_type, event_id FROM events WHERE event_type IN ('click', 'view')) SELECT c_custkey AS id, coalesce(max_by(event_type, event_id), 'raw') AS status, count(event_id) > 1 AS supersedes FROM customer LEFT JOIN d ON user_id = c_custkey GROUP BY 1")
def g18(t):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.lit("raw").alias("status"))
    decisions = t.events.where("event_type in ('click', 'view')").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("at"))
    return graph.reviewed(base, decisions)


@query("g19_assertions", f"WITH {E} SELECT 'assertion_' || {_uuid5("src || ':' || rel || ':' || dst || ':nation'")} AS assertion_id, src, dst FROM edges WHERE rel = 'PARENT_COMMUNITY'")
def g19(t):
    return graph.assertions(substrate.edges(t).where("rel = 'PARENT_COMMUNITY'").withColumn("evidence", F.lit("nation")), "evidence").select("assertion_id", "src", "dst")


@query(
    "g20_source_tree",
    """SELECT conv_id::VARCHAR AS src, 'HAS_PAGE' AS rel, conv_id || '/' || turn // 3 AS dst FROM conversations UNION SELECT conv_id || '/' || turn // 3, 'HAS_CHUNK', conv_id || '/' || turn // 3 || '/' || turn FROM conversations""",
)
def g20(t):
    return quality.source_tree(t.conversations.select(F.col("conv_id").alias("document"), F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("part")))


@query("x7_label_consolidation", f"WITH {N} SELECT CASE label WHEN 'Customer' THEN 'Actor' WHEN 'Equipment' THEN 'Actor' ELSE label END AS label, count(*) AS n FROM nodes GROUP BY 1")
def x7(t, spark):
    mapping = spark.createDataFrame([("Customer", "Actor"), ("Equipment", "Actor")], "label string, to string")
    mapped = substrate.nodes(t).join(F.broadcast(mapping), "label", "left")  # the mapping is supplied by the caller: a few labels
    return mapped.groupBy(F.coalesce("to", "label").alias("label")).agg(F.count("*").alias("n"))


@query(
    "x2_chunk_combination",
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, ((p - 1) // 3)::BIGINT AS part, string_agg(text, '' ORDER BY p) AS text, count(*)::INT AS n_chunks FROM n GROUP BY ALL",
)
def x2(t):
    from veritrail.operators.chunking import combined

    numbered = t.conversations.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return combined(numbered, "conv_id", "position", "text", 3)


@query("s24_rdf_triples", "SELECT 's:' || s_suppkey AS s, 'acctbal' AS p, s_acctbal::VARCHAR AS o, 'decimal' AS datatype FROM supplier WHERE false UNION ALL SELECT 'r%3A' || r_regionkey, 'name', r_name, 'string' FROM region UNION ALL SELECT 'r%3A' || r_regionkey, 'type', 'Region', 'iri' FROM region")
def s24(t):
    from veritrail.sources.rdf import triples

    nodes = t.region.select(substrate.key("r", "r_regionkey").alias("id"), F.array(F.lit("Region")).alias("labels"), F.create_map(F.lit("name"), F.col("r_name"), F.lit("embedding"), F.lit("[]")).alias("props"))
    edges = t.region.select(F.lit("a").alias("src"), F.lit("R").alias("rel"), F.lit("b").alias("dst")).where("false")
    return triples(nodes, edges)


@query("f1_contradiction_ids", f"SELECT doc_id, 'contradiction_' || {_uuid5("doc_id || ':' || (doc_id + 1)")} AS id FROM labels")
def contradiction_ids(t):
    return t.labels.select("doc_id", ids.stable_id("contradiction", F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string"))).alias("id"))


@query("g16_consensus", "SELECT source AS topic, count(DISTINCT doc_id) AS claims FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def g16e(t):
    return quality.consensus(t.documents.join(t.labels.where("quality = 1"), "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("topic")))


@query("g16_applicability", "SELECT source AS technology, doc_id AS claim, lang AS geo_scope, 'evidence_available' AS status FROM documents WHERE n_chars > 5000")
def g16f(t):
    claims = t.documents.where("n_chars > 5000").select(F.col("source").alias("technology"), F.col("doc_id").alias("claim"), F.col("lang").alias("geo_scope"))
    return quality.applicability(claims)


@query("d2_unknown_relations", f"WITH {E} SELECT rel, count(*) AS n FROM edges WHERE rel IN ('PLACED', 'IN_COMMUNITY', 'PARENT_COMMUNITY') GROUP BY 1")
def d2(t):
    from veritrail.schema import unknown_relations

    return unknown_relations(substrate.edges(t)).groupBy("rel").agg(F.count("*").alias("n"))
