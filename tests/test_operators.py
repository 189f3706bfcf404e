"""Operators on small tables: metamorphic checks, gates, sources and streams."""

import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.operators import agent, align, chunking, graph, quality, relational, retrieval, search
from veritrail.sources import ontology, rdf, readers, sinks
from veritrail.streaming import jobs, live


def greedy(rows, limit):
    out, docs, corpora = [], {}, {}
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if docs.get(r[1], 0) < 3 and corpora.get(r[2], 0) < 8 and len(out) < limit:
            out.append(r[0])
            docs[r[1]] = docs.get(r[1], 0) + 1
            corpora[r[2]] = corpora.get(r[2], 0) + 1
    return out


def staged(rows, limit):
    """What diversified does, in plain Python."""
    rows, docs, corpora, out = sorted(rows, key=lambda r: (-r[3], r[0])), {}, {}, []
    kept = [r for r in rows if docs.setdefault(r[1], []).append(r) or len(docs[r[1]]) <= 3]
    kept = [r for r in kept if corpora.setdefault(r[2], []).append(r) or len(corpora[r[2]]) <= 8]
    return [r[0] for r in kept[:limit]] or out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 50)), max_size=60), st.integers(1, 30))
def test_staged_caps_equal_the_greedy_choice(pairs, limit):
    rows = [(k, d, d % 3, s) for k, (d, s) in enumerate(pairs)]
    assert staged(rows, limit) == greedy(rows, limit)


def test_diversified(spark):
    rnd = random.Random(1)
    rows = [(k, d := rnd.randint(0, 12), d % 3, rnd.randint(0, 50)) for k in range(120)]
    frame = spark.createDataFrame(rows, "chunk_id long, document_id long, corpus_id long, score long")
    for limit in (5, 20, 60):
        assert [r["chunk_id"] for r in relational.diversified(frame.repartition(5), limit).collect()] == greedy(rows, limit)


def test_fusion_by_hand(spark):
    rows = [("c", "bm25", 1, 2.0), ("c", "bm25", 2, 1.0), ("c", "dense", 2, 0.5), ("d", "bm25", 3, 7.0), ("d", "dense", 4, 0.0)]
    got = {r["chunk_id"]: r for r in relational.fused(spark.createDataFrame(rows, "corpus_id string, channel string, chunk_id long, score double"), 10).collect()}
    assert got[2]["rrf"] == pytest.approx(1 / 62 + 1 / 61) and got[2]["rrf_norm"] == 1.0
    assert (got[1]["bm25_norm"], got[2]["bm25_norm"], got[2]["dense_norm"], got[3]["bm25_norm"], got[4]["dense_norm"]) == (1.0, 0.0, 1.0, 1.0, 0.0)


def test_search_does_not_depend_on_row_order(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice("shesh license therefore some other words".split()) for _ in range(30)), f"s{i % 4}") for i in range(120)], "doc_id long, text string, source string")
    first = retrieval.cross_corpus_search(docs).collect()
    assert first == retrieval.cross_corpus_search(docs.orderBy(F.rand(3)).repartition(7)).collect() and len(first) == 20
    assert retrieval.cross_corpus_search(docs.where("false")).count() == 0
    assert max(sum(r["corpus_id"] == c for r in first) for c in {r["corpus_id"] for r in first}) <= 8


def test_index_of_terms_reads_few_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red green"), (2, "green blue blue")], "doc_id long, text string")
    sinks.write_index(search.postings(docs, "doc_id", "text"), str(tmp_path / "idx"), 8)
    got = {(r["chunk_id"], r["tf"]) for r in sinks.read_terms(spark, str(tmp_path / "idx"), ["blue", "red"], 8).collect()}
    assert got == {(2, 2), (1, 1)}


def test_components_and_communities(spark):
    edges = [(f"a{i}", "R", f"a{i + 1}") for i in range(30)] + [("b1", "R", "b2"), ("b2", "R", "b2")]
    e = spark.createDataFrame(edges, "src string, rel string, dst string")
    nodes = spark.createDataFrame([(f"a{i}",) for i in range(31)] + [("b1",), ("b2",), ("z",)], "id string")
    got = {r["id"]: r["component"] for r in graph.components(nodes, e).collect()}
    assert {got[f"a{i}"] for i in range(31)} == {"a0"} and got["b2"] == "b1" and got["z"] == "z"
    cliques = [(f"{c}{i}", "R", f"{c}{j}") for c in "xyz" for i in range(5) for j in range(i + 1, 5)] + [("x0", "R", "y0"), ("y1", "R", "z1")]
    weighted = graph.projection(spark.createDataFrame(cliques, "src string, rel string, dst string"))
    found = graph.communities(weighted, levels=2, rounds=6)
    finest = found.where("level = 0").select("id", "community")
    assert finest.count() == 15
    alone = graph.modularity(weighted, finest.select("id", F.col("id").alias("community"))).first()[0]
    assert graph.modularity(weighted, finest).first()[0] > max(0.4, alone)
    assert graph.label_communities(weighted).count() == 15


def test_merge_redirects_edges(spark):
    nodes = spark.createDataFrame([("a", "L"), ("b", "L"), ("c", "L")], "id string, label string")
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("a", "R", "c")], "src string, rel string, dst string")
    left, moved = graph.merged(nodes, edges, spark.createDataFrame([("b", "a")], "duplicate string, keep string"))
    assert {r["id"] for r in left.collect()} == {"a", "c"} and [tuple(r) for r in moved.collect()] == [("a", "R", "c")]


def test_pathways_complete_and_not(spark):
    experiments = spark.createDataFrame([("e1", 0.9, None), ("e2", 0.8, "conflicting")], "id string, confidence double, status string")
    branch = lambda *rows: spark.createDataFrame(list(rows), "experiment string, id string, confidence double, status string")
    every = {"material": branch(("e1", "m", 0.7, None), ("e2", "m", None, None)), "process": branch(("e1", "p", 0.95, None), ("e2", "p", None, None)),
             "equipment": branch(("e1", "q", None, None)), "result": branch(("e1", "r", 0.6, None))}
    rows = retrieval.pathways(experiments, every, 10).collect()
    assert [(r["experiment"], r["complete"], r["missing"], r["confidence"], r["status"]) for r in rows] == [("e1", True, [], 0.6, "low_confidence"), ("e2", False, ["equipment", "result"], 0.8, "conflicting")]
    assert retrieval.pathways(experiments, every, 10, include_incomplete=False).count() == 1


def test_shapes(spark):
    nodes = spark.createDataFrame([("m1", "Measurement", "ok", None, 1.0, None), ("m2", "Measurement", None, None, None, None)], "id string, label string, validation_status string, numeric_value double, value_min double, value_max double")
    edges = spark.createDataFrame([("m1", r, "x") for r in ("MEASURES_PROPERTY", "HAS_UNIT", "EVIDENCED_BY")] + [("m2", "HAS_UNIT", "x")], "src string, rel string, dst string")
    got = {(r["id"], r["path"]) for r in quality.violations(nodes, edges, quality.SHAPES[:1]).collect()}
    assert got == {("m2", "validation_status"), ("m2", "value"), ("m2", "MEASURES_PROPERTY"), ("m2", "EVIDENCED_BY")}


# ---- agent --------------------------------------------------------------------------------------------------------


def test_gates():
    a = agent.analyse("optimal temperature range of leaching")
    assert a.numeric and {"unit", "basis_for_optimality", "process"} <= set(a.required)
    slots = a.required
    full = [agent.Item(str(k), f"s{k}", "text", slots, [{"unit": "%"}]) for k in range(2)]
    assert agent.judge(a, full).action == "answer_full" and agent.judge(a, full).score == 100
    bare = [agent.Item("1", "s", "t", slots, [{"unit": None}])]
    assert not agent.judge(a, bare).gates["numeric_value_and_unit"] and agent.judge(a, bare).action == "search_more"
    cost = agent.analyse("compare capex of options")
    one_sided = [agent.Item(str(k), f"s{k}", "capex is known", cost.required, [{"unit": "%"}]) for k in range(2)]
    assert not agent.judge(cost, one_sided, final=True).gates["economic_metrics"]
    both = [agent.Item(str(k), f"s{k}", "capex and opex are known", cost.required, [{"unit": "%"}]) for k in range(2)]
    assert agent.judge(cost, both).gates["economic_metrics"]
    assert agent.judge(a, full, contradictions=1).action == "search_more"


def test_analysis_of_a_table_is_that_of_each_question(spark):
    from veritrail.plans.q_retrieval import QUESTIONS

    asked = [*QUESTIONS, "compare capex and opex", "никель и медь: обжиг при 700 °C", "", "Russia vs world practice 2021"]
    rows = agent.analysed(spark.createDataFrame([(q,) for q in asked] + [(None,)], "text string")).collect()
    for q, r in zip([*asked, ""], rows):
        a = agent.analyse(q)
        assert (r["intent"], r["answer_type"], r["required"], r["materials"], r["processes"], r["numeric"], r["geography"], r["world"], r["time"]) == (
            a.intent, a.answer_type, a.required, a.materials, a.processes, a.numeric, a.geography, a.world, a.time), q


def test_loop_stops_when_the_gates_pass_and_reports():
    asked = []

    def search_once(queries, strategy):
        asked.append(strategy)
        return [agent.Item(f"{strategy}{k}", f"s{k}", "found", agent.analyse("plain question").required) for k in range(2)] if strategy == "missing_slots" else []

    verdict, items, timeline = agent.evidence_loop("plain question", search_once)
    assert asked == ["broad", "missing_slots"] and verdict.action == "answer_full" and timeline[-1] == "complete" and [i.label for i in items] == ["S1", "S2"]
    result = agent.answer(verdict, items, False)
    report = agent.markdown_report("plain question", result, items)
    assert result["mode"] == "full_answer" and "[S1]" in report and "missing_slots0" not in report
    with pytest.raises(ValueError):
        agent.markdown_report("q", result, items, status="running")
    empty = agent.answer(agent.judge(agent.analyse("x"), [], final=True), [], False)
    assert empty["mode"] == "NO_EVIDENCE_FOUND" and empty["confidence"] <= 0.49


# ---- chunks, sources, streams -------------------------------------------------------------------------------------


def test_chunks_cover_the_text():
    rnd = random.Random(3)
    for _ in range(200):
        body = "".join(rnd.choice("ab. \n") for _ in range(rnd.randint(0, 400)))
        found = chunking.cuts(body, 50, 10)
        assert "".join(body[max(a, found[k - 1][2] if k else 0) : b] for k, (_, a, b) in enumerate(found)) == body


def test_minute_buckets(spark):
    rows = [("v", s, f"t{s}") for s in (0, 30, 60, 61, 119, 300, 310)]
    got = [(r["bucket"], r["start_time"], r["end_time"]) for r in align.minute_buckets(spark.createDataFrame(rows, "video string, start long, text string")).orderBy("bucket").collect()]
    assert got == [(0, 0, 60), (1, 61, 300), (2, 310, 310)]


def test_files(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, data in {"A/x.PDF": b"1", "b/y.docx": b"22", "b/z.txt": b"3"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    assert [tuple(r) for r in readers.inventory(spark, str(root)).collect()] == [("A/x.PDF", "A", 1), ("b/y.docx", "b", 2)]
    (tmp_path / "m.json").write_text('{"documents": [{"category": "a", "path": "a/1"}, {"category": "b", "path": "b/1"}]}')
    assert readers.manifest(spark, str(tmp_path / "m.json"), 1, 2).count() == 2
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "m.json"))
    (tmp_path / "bad.json").write_text('{"documents": [{"category": "a", "path": "../1"}, {"category": "b", "path": "b/1"}]}')
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "bad.json"), 1, 2)
    made = readers.parsed_documents(spark.read.format("binaryFile").load(str(root / "b" / "z.txt"))).first()
    assert made["file_name"] == "z.txt" and made["version_id"] == "docver_" + made["sha256"] and made["size_bytes"] == 1


def test_word_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    xml = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr></w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    got = [(r["kind"], r["text"]) for r in readers.openxml_elements(spark.read.format("binaryFile").load(str(tmp_path / "d.docx"))).collect()]
    assert got == [("text", "Hello"), ("table_row", "a | b")]


def test_workbooks_and_spools(spark, tmp_path):
    (tmp_path / "s.csv").write_text("h1,h2\na,\n,b\n")
    assert sorted(r["text"] for r in readers.workbook_rows(spark, str(tmp_path / "s.csv")).collect()) == [" | b", "a | "]
    sinks.spool(spark.range(3), str(tmp_path / "spool"))
    assert spark.read.json(str(tmp_path / "spool")).count() == 3
    sinks.write_corpus(spark.range(4).withColumn("corpus_id", F.lit("c")), str(tmp_path / "c"))
    assert (tmp_path / "c" / "corpus_id=c").is_dir() and "| documents | 3 |" in sinks.quality_report({"documents": 3}, True)


def test_ontology_and_triples(spark):
    triples = ontology.read_turtle('@prefix m: <http://x/> .\n# note\nm:A a owl:Class ; rdfs:subClassOf m:B ; rdfs:label "A; b." .\nm:r a owl:ObjectProperty ; rdfs:domain [ a owl:Class ] .\n')
    assert [tuple(r) for r in ontology.subclasses(spark, triples).collect()] == [("A", "B")]
    assert {tuple(r) for r in ontology.terms(spark, triples).collect()} == {("A", "class"), ("r", "object_property")}
    nodes = spark.createDataFrame([("a b/1", ["M", "CanonicalEntity"], {"name": 'say "x"', "confidence": "0.5", "embedding": "[]"})], "id string, labels array<string>, props map<string,string>")
    edges = spark.createDataFrame([("a b/1", "R", "c")], "src string, rel string, dst string")
    lines = {r["value"] for r in rdf.n_triples(rdf.triples(nodes, edges), "http://x/").collect()}
    assert '<http://x/a%20b%2F1> <http://x/name> "say \\"x\\"" .' in lines and "<http://x/a%20b%2F1> <http://x/R> <http://x/c> ." in lines and len(lines) == 4


def test_run_states_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 5, ("queued", "running", "complete")[(i // 5) % 3]) for i in range(60)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string")
    for k in range(3):
        frame.where(f"event_id >= {20 * k} and event_id < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.run_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["user_id"]: (r["status"], r["event_id"]) for r in spark.sql("SELECT user_id, max_by(status, event_id) AS status, max(event_id) AS event_id FROM states GROUP BY 1").collect()}
    assert got == {r["user_id"]: (r["status"], r["event_id"]) for r in live.latest_status(frame).collect()}


def test_jobs_and_limits(spark):
    assert jobs.capacity(600) == 30 and jobs.capacity(-5) == 0
    limiter = live.RateLimiter(1.0)
    assert limiter.rejected() == 1.5 and limiter.accepted() == pytest.approx(1.47)
    old = spark.createDataFrame([(1, "a", 1)], "k long, name string, v long")
    new = spark.createDataFrame([(1, None, 2), (2, "b", None)], "k long, name string, v long")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a", 2), (2, "b", None)]


def test_supplier_communities_read_all_orders(spark, tmp_path):
    from veritrail.plans import registry

    rows = [(o, s) for o in range(1, 6) for s in (1, 2, 3)] + [(o, s) for o in range(81, 86) for s in (4, 5, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {frozenset({"s1", "s2", "s3"}), frozenset({"s4", "s5", "s6"})}
    for name in ("g2_communities", "g2_label_propagation"):
        found = {}
        for r in registry.QUERIES[name](spark, str(tmp_path)).collect():
            found.setdefault((r.asDict().get("level"), r["community"]), set()).add(r["id"])
        assert {frozenset(x) for x in found.values()} == want, name


def test_segment_alignment_reads_all_conversations(spark, tmp_path):
    from veritrail.plans import registry

    rows = [(c, t, "user", f"words about topic {t} of case {c}") for c in (3, 20, 5000) for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["f47_segment_alignment"](spark, str(tmp_path)).collect()
    assert {r["chunk_id"] for r in got} == {f"{c}-{t}" for c, t, _, _ in rows}


def test_evidence_tools_take_tables(spark):
    experiments = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, None), (4, 0.9)], "id long, confidence double")
    facet = lambda rows: spark.createDataFrame(rows, "id long, score double")
    first, second = facet([(1, 0.45), (1, 1.0), (2, 0.5), (3, 0.9), (4, 0.44)]), facet([(1, 0.5), (2, 1.0), (3, 0.6)])
    assert [(r["id"], r["match"]) for r in retrieval.find_experiments(experiments, [first, second]).collect()] == [(2, 0.75), (1, 0.75), (3, 0.75)]
    assert [r["id"] for r in retrieval.find_experiments(experiments, [first], experiments.where("id in (1, 4)")).collect()] == [1]
    assert [r["id"] for r in retrieval.find_experiments(experiments, []).collect()] == [2, 4, 1, 3]
    claims = spark.createDataFrame([(1, 0.3, None, None), (2, 0.1, 0.8, 0.3), (3, 0.1, 0.9, 0.2), (4, 1.0, 1.0, 1.0), (5, None, None, None)], "id long, problem double, constraint double, context double")
    assert [(r["id"], r["score"], r["constraint_status"]) for r in retrieval.find_technologies(claims).collect()] == [(4, 1.0, "met"), (1, 0.3, "unknown"), (2, 0.235, "met")]
    works = spark.createDataFrame([("a", 1, 0.9, None), ("a", 1, 0.9, 0.5), ("a", 2, 0.9, 0.1), ("b", 1, 0.1, None), ("c", 3, None, None)], "expert string, work long, topic double, process double")
    assert [(r["expert"], round(r["score"], 6)) for r in retrieval.find_experts(works).collect()] == [("a", 0.3)]
    found = spark.createDataFrame([("Nickel slag", "low"), ("nickel", "medium"), ("zinc", "high"), (None, "high")], "topic string, severity string")
    assert [r["severity"] for r in retrieval.find_findings(found, {"topic": "NICKEL"}, "severity").collect()] == ["medium", "low"]
    reports = spark.createDataFrame([(1, [(1, 5.0), (2, 4.0), (3, 0.0)]), (2, [(4, 4.5)]), (3, None)], "community long, p array<struct<point: long, score: double>>")
    assert [r["point"] for r in retrieval.map_reduced(reports, F.col("p"), per_community=1).collect()] == [1, 4]
    assert retrieval.find_technologies(claims.limit(0)).count() == retrieval.map_reduced(reports.limit(0), F.col("p")).count() == 0
