"""Joins, aggregates, windows, ordering and sets (J, A, W, L and U entries) over the provided tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import evidence, text
from veritrail.operators import chunking, counters, ranked, search
from veritrail.operators.graph import both_ways, reachable, saved, shared_neighbours, tree_closure
from veritrail.operators.ranking import numbered, recall
from veritrail.operators.relational import capped, diversified, fused, latest, maximal_sets, merged_properties, page, round_robin, slot_coverage, upsert
from veritrail.operators.retrieval import conditions_match
from veritrail.plans import substrate
from veritrail.plans.catalog import query

r6 = lambda c: F.round(c, 6)

# ---- joins --------------------------------------------------------------------------------------------------------


@query("j1_chunks_documents", "SELECT c.conv_id, c.turn, d.source FROM conversations c JOIN documents d ON c.conv_id = d.doc_id")
def j1(t):
    return t.conversations.join(t.documents, F.col("conv_id") == F.col("doc_id")).select("conv_id", "turn", "source")


@query("j2_missing_embeddings", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL")
def j2(t):
    return t.documents.join(t.labels, "doc_id").join(t.embeddings.select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left").where("vec_id is null").select("doc_id")


@query("j3_load_job", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 33")
def j3(t):
    return t.orders.where("o_orderkey = 33").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j4_left_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j4(t):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j5_single_hop", f"WITH {substrate.NODES_SQL}, {substrate.EDGES_SQL} SELECT a.name AS src, b.name AS dst FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE e.rel = 'USES_EQUIPMENT' AND b.name LIKE '%7'")
def j5(t):
    n = substrate.nodes(t)
    e = substrate.edges(t).where("rel = 'USES_EQUIPMENT'")
    b = n.where(F.col("name").like("%7")).select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return e.join(b, "dst").join(n.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").select(F.col("a").alias("src"), F.col("b").alias("dst"))


@query("j6_undirected_degree", f"WITH {substrate.EDGES_SQL}, u AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) SELECT a AS id, count(DISTINCT b) AS degree FROM u GROUP BY a")
def j6(t):
    return both_ways(substrate.edges(t)).groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("degree"))


@query(
    "j7_optional_branches",
    """WITH p AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey)) AS parts FROM lineitem WHERE l_quantity > 45 GROUP BY 1),
    s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM lineitem WHERE l_discount > 0.08 GROUP BY 1)
    SELECT o_orderkey, parts, suppliers FROM orders LEFT JOIN p ON p.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey""",
)
def j7(t):
    branch = lambda test, col, name: t.lineitem.where(test).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(col)).alias(name))
    return t.orders.select("o_orderkey").join(branch("l_quantity > 45", "l_partkey", "parts"), "o_orderkey", "left").join(branch("l_discount > 0.08", "l_suppkey", "suppliers"), "o_orderkey", "left")


@query("j8_left_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def j8(t):
    return t.part.join(t.lineitem.where("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query(
    "j9_shared_neighbour_pairs",
    "WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT a.s AS a, b.s AS b, count(*) AS shared FROM s a JOIN s b ON a.p = b.p AND a.s < b.s GROUP BY ALL",
)
def j9(t):
    return shared_neighbours(t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("met")))


@query(
    "j10_bounded_paths",
    f"""WITH {substrate.EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM edges), s AS (SELECT 'c:' || c_custkey AS id FROM customer),
    h1 AS (SELECT DISTINCT s.id AS origin, e.dst AS id FROM s JOIN e ON e.src = s.id), h2 AS (SELECT DISTINCT h1.origin, e.dst AS id FROM h1 JOIN e ON e.src = h1.id),
    h3 AS (SELECT DISTINCT h2.origin, e.dst AS id FROM h2 JOIN e ON e.src = h2.id) SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3""",
)
def j10(t):
    found = reachable(t.customer.select(substrate.number("c", "c_custkey").alias("id")), substrate.every_edge(t, substrate.number), 3)
    return found.select(*(substrate.named(F.col(c)).alias(c) for c in ("origin", "id")))


@query(
    "j11_tree_closure",
    """WITH RECURSIVE p AS (SELECT 's:' || s_suppkey AS child, 'n:' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation),
    c AS (SELECT child, parent AS ancestor, 1 AS distance FROM p UNION ALL SELECT c.child, p.parent, distance + 1 FROM c JOIN p ON p.child = c.ancestor) SELECT child, ancestor, distance::INT AS distance FROM c""",
)
def j11(t):
    parents = t.supplier.select(substrate.key("s", "s_suppkey").alias("child"), substrate.key("n", "s_nationkey").alias("parent"))
    parents = parents.union(t.nation.select(substrate.key("n", "n_nationkey"), substrate.key("r", "n_regionkey")))
    return tree_closure(parents, 3)


@query(
    "j14_range_overlap",
    """WITH c AS (SELECT l_orderkey AS id, 'quantity' AS p, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1 UNION ALL
    SELECT l_orderkey, 'discount', min(l_discount), max(l_discount) FROM lineitem GROUP BY 1)
    SELECT id FROM c WHERE (p = 'quantity' AND high >= 48 AND low <= 3) OR (p = 'discount' AND low <= 0.01) GROUP BY id HAVING count(DISTINCT p) = 2""",
)
def j14(t, spark):
    def ranges(name, col):
        return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.min(col).alias("low"), F.max(col).alias("high")).select("id", F.lit(name).alias("parameter"), "low", "high", F.lit(None).cast("string").alias("unit"))

    wanted = spark.createDataFrame([("quantity", 48.0, 3.0, None), ("discount", None, 0.01, None)], "parameter string, min double, max double, unit string")
    return conditions_match(ranges("quantity", "l_quantity").union(ranges("discount", "l_discount")), wanted)


@query("j15_fuzzy_resolution", "SELECT p_partkey, levenshtein(lower(p_name), 'part 12')::INT AS d FROM part WHERE levenshtein(lower(p_name), 'part 12') <= 6")
def j15(t):
    return t.part.withColumn("d", F.levenshtein(F.lower("p_name"), F.lit("part 12"), 6)).where("d >= 0").select("p_partkey", "d")


@query("j22_upsert", "SELECT coalesce(n.k, o.s_suppkey) AS k, coalesce(n.name, o.s_name) AS name FROM (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey < 60) o FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_suppkey END AS name FROM supplier WHERE s_suppkey > 30) n ON n.k = o.s_suppkey")
def j22(t):
    old = t.supplier.where("s_suppkey < 60").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    new = t.supplier.where("s_suppkey > 30").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("new "), F.col("s_suppkey").cast("string"))).alias("name"))
    return upsert(old, new, ["k"])


@query("j23_local_references", "SELECT c.conv_id, c.turn, p.turn AS ref FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def j23(t):
    refs = t.conversations.select("conv_id", "turn", (F.col("turn") - 1).alias("ref"))
    known = t.conversations.select("conv_id", F.col("turn").alias("ref"))
    return refs.join(known, ["conv_id", "ref"]).select("conv_id", "turn", "ref")


@query("j24_lookup_weight", "SELECT doc_id, CASE source WHEN 'src0' THEN 1.15 WHEN 'src1' THEN 1.05 ELSE 1.0 END::DOUBLE AS weight FROM documents")
def j24(t):
    from veritrail.operators.retrieval import corpus_weight

    return t.documents.select("doc_id", corpus_weight(F.col("source"), {"src0": 1.15, "src1": 1.05}).alias("weight"))


@query("j25_answers_with_testset", "SELECT item_id, count(doc_id) AS n FROM benchmark LEFT JOIN documents ON item_id = doc_id AND lang = 'en' GROUP BY item_id")
def j25(t):
    d = t.documents.where("lang = 'en'").select("doc_id")
    return t.benchmark.join(d, F.col("item_id") == F.col("doc_id"), "left").groupBy("item_id").agg(F.count("doc_id").alias("n"))


# ---- aggregates ---------------------------------------------------------------------------------------------------


@query("a1_stage_counts", "SELECT o_orderstatus AS stage, count(*) AS n, count(CASE WHEN o_totalprice > 1000 THEN 1 END) AS embedded FROM orders GROUP BY 1")
def a1(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("stage")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_totalprice") > 1000, 1)).alias("embedded"))


@query("a2_latest_by_sha", "SELECT sha256(text) AS sha, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def a2(t):
    return latest(t.documents.select(F.sha2("text", 256).alias("sha"), "doc_id"), ["sha"], [F.desc("doc_id")])


@query(
    "a3_merged_properties",
    "SELECT user_id AS id, max_by(value, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) FILTER (value IS NOT NULL AND event_type = 'click') AS click_value, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_type FROM events GROUP BY 1",
)
def a3(t):
    order = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    rows = t.events.select(F.col("user_id").alias("id"), order.alias("at"), F.when(F.col("event_type") == "click", F.col("value")).alias("click_value"), "event_type")
    return merged_properties(rows, "id", "at", ["click_value", "event_type"])


@query("a4_corpus_version", "SELECT coalesce(max(doc_id)::VARCHAR, 'empty') || ':' || count(*) AS version, (SELECT coalesce(max(doc_id)::VARCHAR, 'empty') || ':' || count(*) FROM documents WHERE source = 'none') AS none FROM documents")
def a4(t):
    version = F.concat_ws(":", F.coalesce(F.max(F.col("doc_id")).cast("string"), F.lit("empty")), F.count("*").cast("string"))
    return t.documents.agg(version.alias("version")).crossJoin(t.documents.where("source = 'none'").agg(version.alias("none")))


@query("a5_collect_distinct", "SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS flags FROM lineitem GROUP BY 1")
def a5(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("flags"))


@query("a6_consensus", "SELECT l_partkey AS topic, count(DISTINCT l_orderkey) AS claims FROM lineitem WHERE l_quantity >= 49 GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2")
def a6(t):
    return t.lineitem.where("l_quantity >= 49").groupBy(F.col("l_partkey").alias("topic")).agg(F.count_distinct("l_orderkey").alias("claims")).where("claims >= 2")


@query(
    "a7_expertise_score",
    """WITH e AS (SELECT s_suppkey, count(DISTINCT l_partkey) FILTER (l_quantity = 50) AS n FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1)
    SELECT s_suppkey AS expert, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['general'] ELSE ['even' || s_suppkey % 2, 'third' || s_suppkey % 3] END) AS topic, round(least(1, 0.2 + 0.1 * n), 6)::DOUBLE AS score FROM e""",
)
def a7(t):
    n = t.lineitem.where("l_quantity = 50").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_partkey").alias("n"))
    third = F.concat(F.lit("third"), (F.col("s_suppkey") % 3).cast("string"))
    topics = F.when(F.col("s_suppkey") % 3 != 0, F.array(F.concat(F.lit("even"), (F.col("s_suppkey") % 2).cast("string")), third))
    scored = t.supplier.join(n, "s_suppkey", "left").select(F.col("s_suppkey").alias("expert"), topics.alias("topics"), F.coalesce("n", F.lit(0)).alias("n"))
    return scored.select("expert", F.explode(F.coalesce("topics", F.array(F.lit("general")))).alias("topic"), r6(F.least(F.lit(1.0), 0.2 + 0.1 * F.col("n"))).alias("score"))


@query("a10_entity_frequency", "SELECT l_partkey AS entity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, entity LIMIT 40")
def a10(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("entity")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(40)


@query("a11_chunk_frequency", "SELECT l_orderkey AS chunk, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, chunk LIMIT 3")
def a11(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("chunk")).agg(F.count_distinct("l_partkey").alias("n")).orderBy(F.desc("n"), "chunk").limit(3)


@query("a12_community_picks", "SELECT n_nationkey AS community, count(DISTINCT s_suppkey) AS rank, sum(s_acctbal) > 0 AS positive FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1 ORDER BY rank, community DESC LIMIT 3")
def a12(t):
    g = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.col("n_nationkey").alias("community"))
    return g.agg(F.count_distinct("s_suppkey").alias("rank"), (F.sum("s_acctbal") > 0).alias("positive")).orderBy("rank", F.desc("community")).limit(3)


@query(
    "a13_inside_outside",
    f"""WITH {substrate.EDGES_SQL}, seed AS (SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT 'p:' || p_partkey FROM part WHERE p_size <= 10),
    e AS (SELECT * FROM edges WHERE rel = 'USES_MATERIAL')
    SELECT 'inside' AS side, src || '>' || dst AS what, 1::BIGINT AS n FROM e WHERE src IN (SELECT id FROM seed) AND dst IN (SELECT id FROM seed) UNION ALL
    (SELECT 'outside', dst, count(*) AS n FROM e WHERE src IN (SELECT id FROM seed) AND dst NOT IN (SELECT id FROM seed) GROUP BY dst ORDER BY n DESC, dst LIMIT 10)""",
)
def a13(t):
    seed = t.orders.where("o_orderpriority = '1-URGENT'").select(substrate.key("o", "o_orderkey").alias("id")).union(t.part.where("p_size <= 10").select(substrate.key("p", "p_partkey")))
    # rows that begin outside go before the rest is made distinct; both sides come from one join, written once
    begins = substrate.every_edge(t).where("rel = 'USES_MATERIAL'").select("src", "dst").join(seed.select(F.col("id").alias("src")), "src", "left_semi").distinct()
    e = saved(begins.join(seed.distinct().select(F.col("id").alias("dst"), F.lit(True).alias("ends")), "dst", "left"))
    inside = e.where("ends").select(F.lit("inside").alias("side"), F.concat_ws(">", "src", "dst").alias("what"), F.lit(1).cast("long").alias("n"))
    outside = e.where("ends IS NULL").groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(10)
    return inside.union(outside.select(F.lit("outside"), "dst", "n"))


@query(
    "a14_document_counts",
    """WITH n AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS materials, count(DISTINCT l_suppkey) AS equipment, count(*) AS measurements FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(materials, 0) AS materials, coalesce(equipment, 0) AS equipment, coalesce(measurements, 0) AS measurements FROM orders LEFT JOIN n ON k = o_orderkey""",
)
def a14(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_partkey").alias("materials"), F.count_distinct("l_suppkey").alias("equipment"), F.count("*").alias("measurements"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.orders.select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", zero("materials"), zero("equipment"), zero("measurements"))


_GRAPH_SQL = """own AS (SELECT o_custkey AS d, o_orderkey AS c FROM orders), held AS (SELECT DISTINCT d, c, l_partkey AS e FROM own JOIN lineitem ON l_orderkey = c), ent AS (SELECT DISTINCT d, e FROM held),
    nxt AS (SELECT o_orderkey AS c, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS other FROM orders), sim AS (SELECT o_orderkey AS c, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS other FROM orders),
    rel AS (SELECT DISTINCT l_partkey AS s, l_returnflag AS r, x AS t FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS x FROM lineitem) WHERE x IS NOT NULL),
    up AS (SELECT DISTINCT p_brand AS child, p_type AS parent FROM part UNION SELECT DISTINCT p_type, 'size ' || p_size FROM part UNION SELECT DISTINCT 'size ' || p_size, 'all' FROM part),
    l0 AS (SELECT DISTINCT d, p_brand AS k FROM ent JOIN part ON p_partkey = e), s1 AS (SELECT DISTINCT d, k, parent FROM l0 JOIN up ON child = k), l1 AS (SELECT DISTINCT d, parent AS k FROM s1),
    s2 AS (SELECT DISTINCT d, k, parent FROM l1 JOIN up ON child = k), l2 AS (SELECT DISTINCT d, parent AS k FROM s2), s3 AS (SELECT DISTINCT d, k, parent FROM l2 JOIN up ON child = k), l3 AS (SELECT DISTINCT d, parent AS k FROM s3),
    n AS (SELECT d, 1 AS g FROM own UNION ALL SELECT d, 2 FROM own UNION ALL SELECT d, 2 FROM held UNION ALL SELECT d, 2 FROM own JOIN nxt USING (c) WHERE other IS NOT NULL UNION ALL SELECT d, 2 FROM own JOIN sim USING (c) WHERE other IS NOT NULL
      UNION ALL SELECT d, 3 FROM ent UNION ALL SELECT a.d, 4 FROM ent a JOIN rel ON rel.s = a.e JOIN ent b ON b.d = a.d AND b.e = rel.t
      UNION ALL SELECT d, 5 FROM l0 UNION ALL SELECT d, 5 FROM l1 UNION ALL SELECT d, 5 FROM l2 UNION ALL SELECT d, 5 FROM l3 UNION ALL SELECT d, 6 FROM ent JOIN part ON p_partkey = e UNION ALL SELECT d, 6 FROM s1 UNION ALL SELECT d, 6 FROM s2 UNION ALL SELECT d, 6 FROM s3)"""
_GRAPH_COUNTS = ", ".join(f"count(*) FILTER (g = {k}) AS {c}" for k, c in enumerate(("chunk_nodes", "chunk_rels", "entity_nodes", "entity_rels", "community_nodes", "community_rels"), 1))


@query(
    "a14_document_graph_counts",
    f"WITH {_GRAPH_SQL} SELECT c_custkey AS document, {_GRAPH_COUNTS}, count(*) FILTER (g IN (1, 3, 5)) AS nodes, count(*) FILTER (g IN (2, 4, 6)) AS rels FROM customer LEFT JOIN n ON d = c_custkey GROUP BY 1",
)
def a14b(t):
    """All counters of a document: customers as documents, orders as chunks, parts as entities, brands, types and sizes as levels of communities."""
    after = lambda *by: F.lead("o_orderkey").over(Window.partitionBy(*by).orderBy("o_orderkey"))
    linked = lambda *by: t.orders.select(F.col("o_orderkey").alias("chunk"), after(*by).alias("other")).where("other IS NOT NULL")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    relations = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("rel"), following.alias("dst")).where("dst IS NOT NULL")
    size = F.concat(F.lit("size "), F.col("p_size").cast("string"))
    step = lambda a, b: t.part.select(a.alias("child"), b.alias("parent"))
    parents = step(F.col("p_brand"), F.col("p_type")).union(step(F.col("p_type"), size)).union(step(size, F.lit("all"))).distinct()
    return counters.document_counts(
        t.customer.select(F.col("c_custkey").alias("document")), t.orders.select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("chunk")),
        t.lineitem.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity")), linked("o_custkey", "o_orderpriority"), linked("o_custkey"), relations,
        t.part.select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("community")), parents,
    )


@query(
    "a15_community_rank_weight",
    """WITH c AS (SELECT 'n:' || c_nationkey AS community, o_orderkey, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL
    SELECT 'r:' || n_regionkey, o_orderkey, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)
    SELECT community, count(DISTINCT c_custkey) AS rank, count(DISTINCT o_orderkey) AS weight FROM c GROUP BY 1""",
)
def a15(t):
    member = t.customer.select("c_custkey", substrate.key("n", "c_nationkey").alias("community"))
    parents = t.nation.select(substrate.key("n", "n_nationkey").alias("child"), substrate.key("r", "n_regionkey").alias("parent"))
    up = tree_closure(parents, 1).select(F.col("child").alias("community"), "ancestor")
    every = member.union(member.join(up, "community").select("c_custkey", "ancestor"))
    met = every.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return met.groupBy("community").agg(F.count_distinct("c_custkey").alias("rank"), F.count_distinct("o_orderkey").alias("weight"))


@query("a19_slot_coverage", "WITH s AS (SELECT unnest(['nthing', 'zzzz', 'license']) AS slot), c AS (SELECT slot, count(doc_id) AS n FROM s LEFT JOIN documents ON contains(lower(text), slot) GROUP BY 1) SELECT slot, n, CASE WHEN n >= 2 THEN 'covered' WHEN n = 1 THEN 'weak' ELSE 'missing' END AS state FROM c")
def a19(t):
    slots = ["nthing", "zzzz", "license"]
    results = t.documents.select(text.matched_slots(slots, F.col("text")).alias("matched_slots"))
    return slot_coverage(results, slots)


@query("a20_entity_merge", "SELECT DISTINCT p_brand AS type, p_type AS name FROM part ORDER BY type, name LIMIT 100")
def a20(t):
    entities = t.part.select(F.explode(F.array(F.struct(F.col("p_brand").alias("type"), F.col("p_type").alias("name")))).alias("e")).select("e.*")
    return entities.where("name <> ''").dropDuplicates(["type", "name"]).orderBy("type", "name").limit(100)


@query("a21_array_union", "SELECT c_custkey, list_sort(list_distinct(['a' || c_nationkey % 3, 'b', 'a1', 'b'])) AS ids FROM customer")
def a21(t):
    own = F.array(F.concat(F.lit("a"), (F.col("c_nationkey") % 3).cast("string")), F.lit("b"))
    return t.customer.select("c_custkey", F.array_sort(F.array_union(own, F.array(F.lit("a1"), F.lit("b")))).alias("ids"))


@query("a22_reducers", "SELECT l_orderkey, min(l_discount) AS confidence, bool_or(l_tax > 0.07) AS any_high, bool_and(l_quantity > 5) AS all_large, max(l_quantity) AS best FROM lineitem GROUP BY 1")
def a22(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_discount").alias("confidence"), F.bool_or(F.col("l_tax") > 0.07).alias("any_high"), F.bool_and(F.col("l_quantity") > 5).alias("all_large"), F.max("l_quantity").alias("best"))


@query(
    "a23_sufficiency_score",
    """WITH g AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS covered, count(DISTINCT l_suppkey) AS sources, bool_or(l_tax > 0.05) AS numeric, bool_and(l_returnflag <> 'R') AS clear FROM lineitem GROUP BY 1)
    SELECT l_orderkey, (CASE WHEN covered >= 5 THEN 25 ELSE round_even(25.0 * covered / 5, 0) END + CASE WHEN numeric THEN 20 ELSE 0 END + 15 + CASE WHEN sources >= 2 THEN 15 ELSE 0 END + 10 + CASE WHEN clear THEN 10 ELSE 0 END + 5)::INT AS score FROM g""",
)
def a23(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("covered"), F.count_distinct("l_suppkey").alias("sources"), F.bool_or(F.col("l_tax") > 0.05).alias("numeric"), F.bool_and(F.col("l_returnflag") != "R").alias("clear"))
    states = dict.fromkeys(("basis_for_optimality", "economic_metrics", "claim_sources", "geography_comparison", "time_filter"), F.lit(True))
    states |= {"numeric_value_and_unit": F.col("numeric"), "two_sources": F.col("sources") >= 2, "contradictions_resolved": F.col("clear")}
    return g.select("l_orderkey", evidence.verdict_score(F.col("covered"), F.lit(5), states).alias("score"))


@query("a24_evaluation_means", "SELECT round(avg((l_linenumber <= 5)::INT), 6) AS recall_5, round(avg((l_linenumber <= 6)::INT), 6) AS recall_6, round(avg(l_discount), 6) AS fact_recall FROM lineitem")
def a24(t):
    share = lambda n: r6(F.avg((F.col("l_linenumber") <= n).cast("int")))
    return t.lineitem.agg(share(5).alias("recall_5"), share(6).alias("recall_6"), r6(F.avg("l_discount")).alias("fact_recall"))


@query(
    "a24_retrieval_recall",
    r"""WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_-]{2,}') AS w FROM documents), p AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM w), tf AS (SELECT doc_id, l, term, count(*) AS tf FROM p GROUP BY ALL),
    n AS (SELECT count(*) AS n, avg(l) AS mean FROM (SELECT DISTINCT doc_id, l FROM tf)), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT DISTINCT doc_id AS question, unnest(w[4:15]) AS term FROM w WHERE doc_id % 20 = 0),
    s AS (SELECT question, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term), n GROUP BY ALL),
    r AS (SELECT question, source, doc_id, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rank FROM s JOIN documents USING (doc_id) QUALIFY rank <= 30),
    g AS (SELECT doc_id AS question, source AS gs FROM documents WHERE doc_id % 20 = 0), b AS (SELECT g.question, min(CASE WHEN r.source = gs THEN rank END) AS d, min(CASE WHEN r.doc_id = g.question THEN rank END) AS e FROM g LEFT JOIN r USING (question) GROUP BY 1)
    SELECT count(*) AS questions, round(avg(coalesce((d <= 5)::INT, 0)), 6) AS document_recall_at_5, round(avg(coalesce((d <= 30)::INT, 0)), 6) AS document_recall_at_30, round(avg(coalesce((e <= 30)::INT, 0)), 6) AS element_recall_at_30,
    round(avg(coalesce(1.0::DOUBLE / d, 0)), 6) AS mean_reciprocal_rank FROM b""",
)
def a24b(t):
    """How well a few words find the text that they are from: every twentieth document asks by its fourth to fifteenth word."""
    texts = t.documents.select(F.col("doc_id"), "source", search.terms_of(F.col("text")).alias("w"))
    asked = texts.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.slice("w", 4, 12)).alias("term"))
    first = ranked.best_by_bm25(t.documents, asked, 30, "doc_id", "text").join(t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document")), "chunk_id")
    gold = t.documents.where("doc_id % 20 = 0").select(F.col("doc_id").alias("question"), F.col("source").alias("document"), F.col("doc_id").alias("element"))
    return recall(first.select(F.col("query_id").alias("question"), "rank", "document", F.col("chunk_id").alias("element")), gold)


@query("a25_mode_statistics", "SELECT event_type AS mode, user_id % 3 AS complexity, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(stddev_samp(value), 6) AS sd FROM events GROUP BY ALL")
def a25(t):
    return t.events.groupBy(F.col("event_type").alias("mode"), (F.col("user_id") % 3).alias("complexity")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), r6(F.stddev_samp("value")).alias("sd"))


@query("a26_size_percentiles", "WITH s AS (SELECT user_id % 4 AS level, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT level, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS most FROM s GROUP BY 1")
def a26(t):
    s = t.events.groupBy((F.col("user_id") % 4).alias("level"), "user_id").agg(F.count("*").alias("n"))
    p = lambda q: r6(F.percentile("n", q)).alias(f"p{round(q * 100)}")
    return s.groupBy("level").agg(p(0.25), p(0.5), p(0.9), p(0.99), F.max("n").alias("most"))


@query("a27_parser_benchmark", "SELECT count(DISTINCT source) AS categories, count(DISTINCT coalesce(n_chars // 3000, 0)) AS pages, count(*) AS chunks FROM documents")
def a27(t):
    return t.documents.agg(F.count_distinct("source").alias("categories"), F.count_distinct(F.coalesce(F.floor(F.col("n_chars") / 3000), F.lit(0))).alias("pages"), F.count("*").alias("chunks"))


@query(
    "a28_token_ledger",
    """SELECT user_id, date_trunc('day', ts)::DATE AS day, sum((props->>'$.k')::BIGINT)::BIGINT AS used, greatest(500 - sum((props->>'$.k')::BIGINT), 0)::BIGINT AS remaining FROM events GROUP BY ALL""",
)
def a28(t):
    from veritrail.streaming.ledger import daily_usage

    return daily_usage(t.events, limit=500)


@query("a29_label_usage", f"WITH {substrate.NODES_SQL}, {substrate.EDGES_SQL} SELECT label AS name, 'label' AS kind, count(*) AS n FROM nodes WHERE label <> 'Nation' GROUP BY 1 UNION ALL SELECT rel, 'relation', count(*) FROM edges WHERE rel NOT IN ('PLACED') GROUP BY 1")
def a29(t):
    labels = substrate.nodes(t).where("label <> 'Nation'").groupBy(F.col("label").alias("name")).agg(F.lit("label").alias("kind"), F.count("*").alias("n"))
    return labels.union(substrate.edges(t).where("rel <> 'PLACED'").groupBy("rel").agg(F.lit("relation"), F.count("*")))


@query("a30_schema_triplets", f"WITH {substrate.NODES_SQL}, {substrate.EDGES_SQL} SELECT DISTINCT a.label AS src_label, rel, b.label AS dst_label FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id")
def a30(t):
    from veritrail.operators.graph import schema_triples

    return schema_triples(substrate.nodes(t), substrate.every_edge(t))


@query("a31_vector_sizes", "SELECT len(embedding)::INT AS size, count(*) AS n FROM embeddings GROUP BY 1")
def a31(t):
    return t.embeddings.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))


@query("a32_distinct_per_caption", f"WITH {substrate.EDGES_SQL} SELECT rel, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY 1")
def a32(t):
    return substrate.edges(t).groupBy("rel").agg(F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query("a33_distinct_scores", "SELECT DISTINCT user_id, round(value, 4) AS score FROM events")
def a33(t):
    return t.events.select("user_id", F.round("value", 4).alias("score")).dropDuplicates(["user_id", "score"])


# ---- windows ------------------------------------------------------------------------------------------------------

_LISTS = """lists AS (SELECT 'c' || vec_id % 3 AS corpus_id, ch AS channel, vec_id AS chunk_id, CASE ch WHEN 'dense' THEN round(embedding[1]::DOUBLE, 6) ELSE round(embedding[2]::DOUBLE, 6) END AS score
    FROM embeddings, (SELECT unnest(['dense', 'bm25']) AS ch) WHERE ch = 'dense' OR vec_id % 2 = 0)"""


def _lists(t):
    e = t.embeddings.select(F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("corpus_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    one = lambda ch, i: e.select("corpus_id", F.lit(ch).alias("channel"), "chunk_id", r6(F.get("embedding", i).cast("double")).alias("score"))
    return one("dense", 0).union(one("bm25", 1).where("chunk_id % 2 = 0"))


@query(
    "w1_w2_w3_rank_fusion",
    f"""WITH {_LISTS}, r AS (SELECT *, row_number() OVER (PARTITION BY corpus_id, channel ORDER BY score DESC, chunk_id) AS rk, min(score) OVER (PARTITION BY corpus_id, channel) AS lo, max(score) OVER (PARTITION BY corpus_id, channel) AS hi FROM lists),
    g AS (SELECT chunk_id, corpus_id, sum(1.0::DOUBLE / (60 + rk)) AS rrf, max(CASE WHEN channel = 'dense' THEN (score - lo) / (hi - lo) END) AS d, max(CASE WHEN channel = 'bm25' THEN (score - lo) / (hi - lo) END) AS b FROM r GROUP BY ALL)
    SELECT chunk_id, corpus_id, round(rrf, 6) AS rrf, round(rrf / (SELECT max(rrf) FROM g), 6) AS rrf_norm, round(coalesce(d, 0), 6) AS dense_norm, round(coalesce(b, 0), 6) AS bm25_norm FROM g ORDER BY g.rrf DESC, chunk_id LIMIT 60""",
)
def w1(t):
    return fused(_lists(t), 60).select("chunk_id", "corpus_id", r6("rrf").alias("rrf"), r6("rrf_norm").alias("rrf_norm"), r6("dense_norm").alias("dense_norm"), r6("bm25_norm").alias("bm25_norm"))


@query(
    "w4_w5_chunk_order",
    """SELECT conv_id, turn, row_number() OVER w AS position, coalesce(sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS content_offset, lag(sha1(text)) OVER w AS previous_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def w4(t):
    return chunking.ordered_chunks(t.conversations, "conv_id", "turn", "text").select("conv_id", "turn", "position", "content_offset", "previous_id")


@query(
    "w5_chunk_edges",
    """WITH o AS (SELECT conv_id::VARCHAR AS d, sha1(text) AS c, lag(sha1(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
    SELECT d AS src, 'FIRST_CHUNK' AS rel, c AS dst FROM o WHERE p IS NULL UNION SELECT c, 'PART_OF', d FROM o UNION SELECT p, 'NEXT_CHUNK', c FROM o WHERE p IS NOT NULL""",
)
def w5(t):
    return chunking.chunk_edges(chunking.ordered_chunks(t.conversations, "conv_id", "turn", "text"), "conv_id")


@query(
    "w6_capped_top_k",
    """WITH s AS (SELECT doc_id AS chunk_id, doc_id // 4 AS document_id, (doc_id // 4) % 7 AS corpus_id, n_chars AS score FROM documents),
    a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) <= 3), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY corpus_id ORDER BY score DESC, chunk_id) <= 8)
    SELECT * FROM b ORDER BY score DESC, chunk_id LIMIT 40""",
)
def w6(t):
    doc = F.floor(F.col("doc_id") / 4)
    return diversified(t.documents.select(F.col("doc_id").alias("chunk_id"), doc.alias("document_id"), (doc % 7).alias("corpus_id"), F.col("n_chars").alias("score")), 40)


@query("w7_round_robin", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS turn FROM documents ORDER BY turn, source LIMIT 50")
def w7(t):
    return round_robin(t.documents.select("doc_id", "source"), "source", [F.col("doc_id")], 50)


@query(
    "w8_preseeded_sample",
    """WITH b AS (SELECT doc_id, source, 0 AS stage, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents QUALIFY n <= 3),
    l AS (SELECT doc_id, source, 1 AS stage, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM b) QUALIFY n <= 2),
    s AS (SELECT * FROM b UNION ALL SELECT * FROM l), r AS (SELECT doc_id, source, 2 AS stage, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s))
    SELECT doc_id, source FROM (SELECT doc_id, source, 0 AS stage, source AS a, stage AS b, n AS c, 0 AS d FROM s UNION ALL SELECT doc_id, source, 1, '', 0, n, dense_rank() OVER (ORDER BY source) FROM r) ORDER BY stage, a, b, c, d LIMIT 130""",
)
def w8(t):
    d = t.documents.select("doc_id", "source", "lang", "n_chars")
    big = capped(d, "source", [F.desc("n_chars"), F.col("doc_id")], 3)
    legacy = capped(d.where("lang = 'de'").join(big.select("doc_id"), "doc_id", "left_anti").select(*d.columns), "source", [F.col("doc_id")], 2)
    seed = big.withColumn("b", F.lit(0)).union(legacy.withColumn("b", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("source", "b").orderBy(F.when(F.col("b") == 0, -F.col("n_chars")).otherwise(0), "doc_id"))
    first = seed.select("doc_id", "source", F.lit(0).alias("stage"), F.col("source").alias("a"), "b", n.alias("c"), F.lit("").alias("d"))
    turn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rest = d.join(seed.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", F.lit(1), F.lit(""), F.lit(0), turn, "source")
    return first.union(rest).orderBy("stage", "a", "b", "c", "d").limit(130).select("doc_id", "source")


@query("w9_evidence_ranking", "SELECT conv_id, turn, n::INT AS n, ((n - 1) // 3 + 1)::INT AS pass FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY len(text) DESC, turn) AS n FROM conversations WHERE len(trim(text)) >= 40) WHERE n <= 6")
def w9(t):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn"))
    return t.conversations.where(F.length(F.trim("text")) >= 40).withColumn("n", n).where("n <= 6").select("conv_id", "turn", "n", (F.floor((F.col("n") - 1) / 3) + 1).cast("int").alias("pass"))


@query("w10_bounded_sample", "WITH m AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS f FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (turn = f) DESC, len(text) DESC, turn) AS n FROM m) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS i FROM r WHERE n <= 3")
def w10(t):
    own = Window.partitionBy("conv_id")
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(own)
    n = F.row_number().over(own.orderBy(F.desc(F.coalesce(F.col("turn") == F.col("f"), F.lit(False))), F.desc(F.length("text")), "turn"))
    kept = t.conversations.withColumn("f", first).withColumn("n", n).where("n <= 3")
    return kept.select("conv_id", "turn", F.row_number().over(own.orderBy("turn")).alias("i"))


@query("w11_citation_labels", "SELECT doc_id, 'S' || row_number() OVER (ORDER BY (quality = 1) DESC, toxic, doc_id) AS label FROM labels")
def w11(t):
    ranked = numbered(t.labels, [F.desc(F.col("quality") == 1), "toxic", "doc_id"])
    return ranked.select("doc_id", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("label"))


@query("w12_ordinal_by_kind", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1)::INT AS ordinal FROM conversations")
def w12(t):
    return t.conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) - 1).alias("ordinal"))


@query(
    "w13_publication_boundaries",
    """WITH RECURSIVE b AS (SELECT l_orderkey, l_linenumber AS s, (l_linenumber + floor(l_quantity / 20))::INT AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, (l_linenumber + floor(l_quantity / 20))::INT) AS n FROM lineitem),
    f AS (SELECT l_orderkey, n, s, e, s >= 1 AND e <= 8 AND s <= e AND s > 0 AS kept, CASE WHEN s >= 1 AND e <= 8 AND s <= e AND s > 0 THEN e ELSE 0 END AS stop FROM b WHERE n = 1 UNION ALL
      SELECT b.l_orderkey, b.n, b.s, b.e, b.s >= 1 AND b.e <= 8 AND b.s <= b.e AND b.s > stop, CASE WHEN b.s >= 1 AND b.e <= 8 AND b.s <= b.e AND b.s > stop THEN b.e ELSE stop END FROM f JOIN b ON b.l_orderkey = f.l_orderkey AND b.n = f.n + 1)
    SELECT l_orderkey, s AS start_page, e AS end_page FROM f WHERE kept""",
)
def w13(t):
    from veritrail.operators.agent import valid_boundaries

    spans = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("start_page"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 20)).cast("int").alias("end_page"))))
    kept = t.lineitem.groupBy("l_orderkey").agg(spans.alias("s")).select("l_orderkey", valid_boundaries(F.col("s"), F.lit(8)).alias("s"))
    return kept.select("l_orderkey", F.explode("s").alias("s")).select("l_orderkey", "s.start_page", "s.end_page")


@query("w14_best_rank", "WITH r AS (SELECT label, vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rk FROM embeddings) SELECT label, min(rk)::INT AS best FROM r GROUP BY 1")
def w14(t):
    ranked = numbered(t.embeddings.select("label", "vec_id", F.get("embedding", 0).alias("first")), [F.desc("first"), "vec_id"])
    return ranked.groupBy("label").agg(F.min("rank").cast("int").alias("best"))


# ---- ordering and sets --------------------------------------------------------------------------------------------


@query("l4_ordered_limit", "SELECT o_orderkey FROM orders ORDER BY coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, 0) DESC, o_orderkey LIMIT 80")
def l4(t):
    return t.orders.orderBy(F.desc(F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")), F.lit(0.0))), "o_orderkey").limit(80).select("o_orderkey")


@query("l5_triple_sort", "SELECT conv_id, turn FROM conversations ORDER BY len(text) % 5 DESC, turn DESC, len(text) DESC, conv_id LIMIT 24")
def l5(t):
    return t.conversations.orderBy(F.desc(F.length("text") % 5), F.desc("turn"), F.desc(F.length("text")), "conv_id").limit(24).select("conv_id", "turn")


@query("l6_page", "SELECT doc_id, (SELECT ceil(count(*) / 10.0)::BIGINT FROM documents) AS pages FROM documents ORDER BY doc_id LIMIT 10 OFFSET 20")
def l6(t):
    pages = t.documents.agg(F.ceil(F.count("*") / 10).alias("pages"))
    return page(t.documents.select("doc_id"), [F.col("doc_id")], 3).crossJoin(pages)


@query("l7_severity_order", "SELECT i, s FROM (SELECT row_number() OVER (ORDER BY s DESC, k) AS i, s FROM (SELECT o_orderkey AS k, ['high', 'medium', 'unknown'][o_orderkey % 3 + 1] AS s FROM orders ORDER BY s DESC, k LIMIT 60))")
def l7(t):
    """The first 60 risks; severities sort as strings: unknown, medium, high."""
    s = F.element_at(F.array(*map(F.lit, ("high", "medium", "unknown"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = t.orders.select(F.col("o_orderkey").alias("k"), s.alias("s")).orderBy(F.desc("s"), "k").limit(60)
    return rows.select(F.row_number().over(Window.orderBy(F.desc("s"), "k")).alias("i"), "s")


@query("l8_representative_order", f"WITH {substrate.EDGES_SQL}, d AS (SELECT dst AS id, count(*) AS degree FROM edges WHERE rel = 'USES_MATERIAL' GROUP BY 1) SELECT id, degree FROM d ORDER BY degree DESC, len(id) DESC, id LIMIT 20")
def l8(t):
    d = substrate.edges(t).where("rel = 'USES_MATERIAL'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return d.orderBy(F.desc("degree"), F.desc(F.length("id")), "id").limit(20)


@query("l9_hard_caps", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_-]{2,}')[1:24])::INT AS n FROM documents")
def l9(t):
    return t.documents.select("doc_id", F.size(text.bm25_tokens(F.col("text"))).alias("n"))


@query("l10_model_cutoff", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 28")
def l10(t):
    from veritrail.operators.agent import document_cutoff

    return t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(document_cutoff("large-context")).select("doc_id")


@query("l11_fifo", "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 100")
def l11(t):
    return t.events.where("event_type = 'click'").orderBy("ts", "event_id").limit(100).select("event_id")


@query("u1_j19_channel_union", f"WITH {_LISTS} SELECT chunk_id, max(CASE WHEN channel = 'dense' THEN score END) AS dense, max(CASE WHEN channel = 'bm25' THEN score END) AS bm25 FROM lists GROUP BY 1")
def u1(t):
    pick = lambda ch: F.max(F.when(F.col("channel") == ch, F.col("score"))).alias(ch)
    return _lists(t).groupBy("chunk_id").agg(pick("dense"), pick("bm25"))


@query("u2_disallowed_relations", f"WITH {substrate.EDGES_SQL} SELECT rel FROM edges EXCEPT SELECT unnest(['PLACED', 'USES_MATERIAL'])")
def u2(t, spark):
    allowed = spark.createDataFrame([("PLACED",), ("USES_MATERIAL",)], "rel string")
    return substrate.edges(t).select("rel").subtract(allowed)


@query("u3_intersection", "SELECT a.o_orderkey, list_sort(list_intersect(a.x, [1, 2, 3, 4])) AS shared FROM (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_suppkey % 7) AS x FROM lineitem GROUP BY 1) a")
def u3(t):
    x = F.collect_set(F.col("l_suppkey") % 7)
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.array_intersect(x, F.array(*[F.lit(v).cast("long") for v in (1, 2, 3, 4)]))).alias("shared"))


@query("u4_ordered_distinct", "SELECT doc_id, (SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(str_split(text, ' ')) AS w, unnest(range(len(str_split(text, ' ')))) AS i) GROUP BY w))[1:6] AS words FROM documents")
def u4(t):
    return t.documents.select("doc_id", F.slice(F.array_distinct(F.split("text", " ")), 1, 6).alias("words"))


@query("u5_collection_algebra", "SELECT l_orderkey, list_sort(list_filter(list_distinct(flatten(list([l_partkey, l_suppkey]))), lambda x: x NOT IN (1, 2, 3))) AS ids FROM lineitem GROUP BY 1")
def u5(t):
    flat = F.array_distinct(F.flatten(F.collect_list(F.array("l_partkey", "l_suppkey"))))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.array_except(flat, F.array(*[F.lit(v).cast("long") for v in (1, 2, 3)]))).alias("ids"))


@query("u6_union_distinct", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity = 50 UNION SELECT l_suppkey FROM lineitem WHERE l_quantity = 49")
def u6(t):
    return t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("k")).union(t.lineitem.where("l_quantity = 49").select("l_suppkey")).distinct()


@query("u7_canonical_dedup", "SELECT count(DISTINCT (event_type, props)) AS n FROM events")
def u7(t):
    return t.events.select(F.to_json(F.struct("event_type", "props")).alias("j")).dropDuplicates(["j"]).agg(F.count("*").alias("n"))


@query("u8_union_all", "SELECT 'node' AS kind, count(*) AS n, round(avg(len(p_name)), 6) AS mean FROM part UNION ALL SELECT 'rel', count(*), round(avg(len(o_orderpriority)), 6) FROM orders")
def u8(t):
    stats = lambda df, kind, c: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), r6(F.avg(F.length(c))).alias("mean"))
    return stats(t.part, "node", "p_name").union(stats(t.orders, "rel", "o_orderpriority"))


@query(
    "u9_maximal_sets",
    """WITH g AS (SELECT l_orderkey AS g, list_sort(list(DISTINCT l_suppkey)) AS m FROM lineitem GROUP BY 1), u AS (SELECT g, len(m) AS n, unnest(m) AS x FROM g),
    s AS (SELECT a.g FROM u a JOIN u b ON a.x = b.x AND b.n > a.n GROUP BY a.g, b.g, a.n HAVING count(*) = a.n)
    SELECT g, m FROM g WHERE g NOT IN (SELECT g FROM s)""",
)
def u9(t):
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("g")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("m"))
    return maximal_sets(g, "g", "m").select("g", "m")
