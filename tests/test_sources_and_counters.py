"""Office files, citations, counters and reports of graphs, ranks over ranges, recall."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veritrail.operators import counters, ranking
from veritrail.sources import citations, openxml, readers

# ---- office files ---------------------------------------------------------------------------------------------------


def test_office_files_from_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.pptx").write_bytes(openxml.presentation([("Title & more\n\n second   line", [["x", "y"], ["1", ""]], "say this"), ("", [], ""), ("last", [], "")]))
    (tmp_path / "deep" / "b.docx").write_bytes(openxml.text_document(["one", " ", "two  words"], [["k", "v"], ["", ""]]))
    (tmp_path / "c.xlsx").write_bytes(openxml.workbook([("First", [["a", "", "c"], ["", "", ""], ["1"]]), ('2"', [])]))
    (tmp_path / "broken.pptx").write_bytes(b"no zip")
    (tmp_path / "empty.docx").write_bytes(openxml.text_document([], []))
    (tmp_path / "other.txt").write_text("text")
    got = defaultdict(list)
    for r in openxml.elements(openxml.office_files(spark, str(tmp_path))).orderBy("path", "position").collect():
        got[r["path"].rsplit("/", 1)[1]].append((r["kind"], r["text"], r["slide_number"], r["sheet_name"], r["row_number"]))
    assert got["a.pptx"] == [
        ("table", "Slide 1 table", 1, None, None), ("table_row", "x | y", 1, None, 1), ("table_row", "1 | ", 1, None, 2), ("text", "Title & more\nsecond line\nSpeaker notes: say this", 1, None, None), ("text", "last", 3, None, None),
    ]
    assert got["b.docx"] == [("text", "one", None, None, None), ("text", "two words", None, None, None), ("table_row", "k | v", None, None, 1)]
    assert got["c.xlsx"] == [("table", "Workbook sheet: First", None, "First", None), ("table_row", "a |  | c", None, "First", 1), ("table_row", "1", None, "First", 3), ("table", 'Workbook sheet: 2"', None, '2"', None)]
    assert [x[0] for x in got["broken.pptx"]] == ["error"] and set(got) == {"a.pptx", "b.docx", "c.xlsx", "broken.pptx"}


def test_slides_come_in_the_order_of_the_presentation():
    import io
    import zipfile

    made = openxml.presentation([("one", [], ""), ("two", [], "")])
    parts = {n: zipfile.ZipFile(io.BytesIO(made)).read(n).decode() for n in zipfile.ZipFile(io.BytesIO(made)).namelist()}
    parts["ppt/presentation.xml"] = parts["ppt/presentation.xml"].replace('r:id="s0"', 'r:id="x"').replace('r:id="s1"', 'r:id="s0"').replace('r:id="x"', 'r:id="s1"')
    assert [e[1] for e in openxml.slides(zipfile.ZipFile(io.BytesIO(openxml._zipped(parts))))] == ["two", "one"]


def test_shared_strings_and_places_of_cells():
    import io
    import zipfile

    made = openxml.workbook([("s", [["x"]])])
    parts = {n: zipfile.ZipFile(io.BytesIO(made)).read(n).decode() for n in zipfile.ZipFile(io.BytesIO(made)).namelist()}
    s = openxml.S[1:-1]
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{s}"><si><t>first</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>'
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{s}"><sheetData><row r="7"><c r="AB7" t="s"><v>1</v></c><c r="A7"><v>2.5</v></c></row></sheetData></worksheet>'
    rows = list(openxml.sheets(zipfile.ZipFile(io.BytesIO(openxml._zipped(parts)))))
    assert rows[1][1] == "2.5" + " | " * 27 + "two runs" and rows[1][4] == 7


def test_lines_of_a_graph(spark):
    lines = spark.createDataFrame([("node\ta\tMaterial",), (" ",), ("edge\ta\tUSES\tb",), ("x",)], "value string")
    assert list(map(tuple, readers.graph_lines(lines).collect())) == [("node", "a", "Material", None), ("edge", "a", "USES", "b"), ("x", None, None, None)]


# ---- citations ------------------------------------------------------------------------------------------------------


def test_citations_are_found_limited_and_tiered(spark):
    import json

    cite = lambda url, title=None: {"type": "url_citation", "url": url, "title": title}
    answer = {"output": [{"content": [{"annotations": [cite("a.org/x", "A"), cite("https://A.org:80/y"), cite("HTTP://evil-a.org/z")]}, {"x": {"y": [cite("https://sub.b.com/1", ""), cite("https://a.org/x", "again"), cite("")]}}]}]}
    rows = [(1, json.dumps(answer)), (2, "not json"), (3, None), (4, json.dumps({"type": "url_citation", "url": "https://user@a.org.evil.com/"}))]
    told = spark.createDataFrame(rows, "answer long, json string")
    cited = told.select("answer", F.posexplode(citations.annotations(F.col("json"))).alias("place", "c")).select("answer", "place", "c.url", "c.title")
    got = citations.cited_sources(cited, [" A.org", "b.com", "a.org"], "science", ["b.com"]).orderBy("place").collect()
    assert [(r["answer"], r["url"], r["host"], r["title"], r["source_type"], r["evidence_tier"]) for r in got] == [
        (1, "https://a.org/x", "a.org", "A", "web", "science"), (1, "https://A.org:80/y", "a.org", "a.org", "web", "science"), (1, "https://sub.b.com/1", "sub.b.com", "sub.b.com", "web_metadata", "metadata"),
    ]
    sure = citations.confidence(citations.cited_sources(cited, ["b.com"], "science", ["b.com"])).first()
    assert (sure["n"], float(sure["confidence"])) == (1, 0.45)
    with pytest.raises(ValueError):
        citations.valid_domains(["a.b"] * 6)
    with pytest.raises(ValueError):
        citations.valid_domains(["no domain"])


# ---- counters -------------------------------------------------------------------------------------------------------


def test_document_counts_equal_brute_force(spark):
    rnd = random.Random(2)
    chunks = [(d, 10 * d + k) for d in range(6) for k in range(rnd.randint(0, 4))] + [(0, 51)]  # a chunk of two documents
    mentions = [(c, f"e{rnd.randint(0, 8)}") for _, c in chunks for _ in range(3)]
    pairs = lambda: [(rnd.choice(chunks)[1], rnd.choice(chunks)[1]) for _ in range(12)]
    similar, following = pairs(), pairs()
    relations = [(f"e{rnd.randint(0, 8)}", rnd.choice("rs"), f"e{rnd.randint(0, 8)}") for _ in range(25)]
    communities, parents = [(f"e{k}", f"c{k % 3}") for k in range(7)], [("c0", "p0"), ("c1", "p0"), ("c1", "p1"), ("p0", "q"), ("p1", "q"), ("q", "top")]
    want = {}
    for d in range(7):
        own = {c for x, c in chunks if x == d}
        held = {(c, e) for c, e in mentions if c in own}
        ents = {e for _, e in held}
        rels = [len(own), len(held), len({(c, o) for c, o in similar if c in own}), len({(c, o) for c, o in following if c in own})]
        inside = {(s, r, t) for s, r, t in relations if s in ents and t in ents}
        level, n_comm, n_rel = {c for e, c in communities if e in ents}, 0, len({(e, c) for e, c in communities if e in ents})
        n_comm += len(level)
        for _ in range(3):
            step = {(c, p) for c, p in parents if c in level}
            level = {p for _, p in step}
            n_comm, n_rel = n_comm + len(level), n_rel + len(step)
        row = [len(own), sum(rels), len(ents), len(inside), n_comm, n_rel]
        want[d] = (*row, row[0] + row[2] + row[4], row[1] + row[3] + row[5])
    frame = spark.createDataFrame
    args = [frame([(d,) for d in range(7)], "document int"), frame(chunks + chunks[:2], "document int, chunk int"), frame(mentions + mentions[:3], "chunk int, entity string"), frame(similar, "chunk int, other int"),
            frame(following, "chunk int, other int"), frame(relations, "src string, rel string, dst string")]
    got = counters.document_counts(*args, frame(communities, "entity string, community string"), frame(parents, "child string, parent string"))
    assert {r["document"]: tuple(r)[1:] for r in got.collect()} == want
    without = counters.document_counts(*args).collect()
    assert all(r["community_nodes"] == 0 and r["chunk_nodes"] == want[r["document"]][0] for r in without)


def test_readiness_of_an_empty_and_a_small_graph(spark):
    nodes = [("d1", "Document", "one", "reports", "ok"), ("d2", "Document", "two", None, "raw"), ("m1", "Material", None, None, None), ("m2", "Material", "lead", None, "raw")]
    graph = spark.createDataFrame(nodes, "id string, label string, name string, category string, status string")
    edges = spark.createDataFrame([("d1", "USES", "m2"), ("d2", "USES", "m2"), ("m2", "LOOP", "m2")], "src string, rel string, dst string")
    report = lambda n, e: {(r["section"], r["name"], r["rank"]): r["value"] for r in counters.readiness(n, e, {"documents": "Document", "claims": "Claim"}, ["Material"], F.col("status") == "raw").collect()}
    assert report(graph, edges) == {
        ("counter", "nodes", None): 4, ("counter", "review_items", None): 2, ("counter", "documents", None): 2, ("counter", "claims", None): 0, ("counter", "relationships", None): 3,
        ("coverage", "reports", None): 1, ("coverage", "unknown", None): 1, ("top", "Material:lead", 1): 4, ("top", "Material:m1", 2): 0,
    }
    none = report(graph.where("false"), edges.where("false"))
    assert set(none.values()) == {0} and len(none) == 5


def test_parent_summaries_fold_upwards(spark):
    leaves = spark.createDataFrame([("a", "first"), ("b", "second"), ("c", "third")], "community string, summary string")
    parents = spark.createDataFrame([("a", "x"), ("b", "x"), ("x", "y"), ("c", "y"), ("y", "z")], "child string, parent string")
    got = {(r["community"], r["level"]): (r["children"], r["summary"]) for r in counters.parent_summaries(leaves, parents, 3, keep=60).collect()}
    assert got["x", 1] == (2, "Summary 1: first Summary 2: second")
    assert got["y", 1] == (1, "Summary 1: third") and got["y", 2] == (1, "Summary 1: Summary 1: first Summary 2: second")
    assert got["z", 3] == (1, ("Summary 1: Summary 1: Summary 1: first Summary 2: second")[:60]) and len(got) == 8


# ---- ranks and recall -----------------------------------------------------------------------------------------------


def test_numbers_over_ranges_are_those_of_one_order(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 1, 2, 2, 3])) for i in range(500)]
    got = {r["id"]: r["rank"] for r in ranking.numbered(spark.createDataFrame(rows, "id int, v int").repartition(5), [F.desc("v"), "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: n for n, (i, _) in enumerate(order, 1)}
    assert ranking.numbered(spark.createDataFrame([], "id int, v int"), ["id"]).count() == 0


def test_recall(spark):
    ranked = spark.createDataFrame([(1, 1, "x", "e9"), (1, 2, "a", "e8"), (1, 7, "a", "e1"), (2, 6, "b", "e2"), (3, 1, "z", "e3")], "question int, rank int, document string, element string")
    gold = spark.createDataFrame([(1, "a", "e1"), (2, "b", "e0"), (2, "b", "e2"), (3, "c", "e7"), (4, "d", "e5")], "question int, document string, element string")
    told = ranking.recall(ranked, gold).first().asDict()
    assert told == {"questions": 4, "document_recall_at_5": 0.25, "document_recall_at_30": 0.5, "element_recall_at_30": 0.5, "mean_reciprocal_rank": round((1 / 2 + 1 / 6) / 4, 6)}
    assert Counter(r["question"] for r in ranked.collect())[1] == 3


# ---- objects in parts -----------------------------------------------------------------------------------------------


def put(root, upload, part, content):
    folder = root / "parts" / f"upload={upload}" / f"part={part}"
    folder.mkdir(parents=True)
    (folder / "object.bin").write_bytes(content)


def contents(frame):
    return {r["upload"]: bytes(r["content"]) for r in frame.collect()}


def test_an_interrupted_merge_goes_on_and_merges_nothing_twice(spark, tmp_path, monkeypatch):
    from veritrail.sources.objects import PartStore

    for upload, parts in {"a": [b"one ", b"two"], "b": [b"\x00\xff"]}.items():
        for k, content in enumerate(parts, 1):
            put(tmp_path, upload, k, content)
    put(tmp_path, "gap", 1, b"x")
    put(tmp_path, "gap", 3, b"z")
    store = PartStore(spark, f"file://{tmp_path}")

    def fail(*_):
        raise OSError("the copy failed")

    with monkeypatch.context() as m:
        m.setattr(PartStore, "commit", fail)
        with pytest.raises(OSError):
            store.run()
    assert store.versions() == [] and contents(store.merged()) == {} and store.listed().count() == 5
    with monkeypatch.context() as m:
        m.setattr(PartStore, "_delete", fail)
        with pytest.raises(OSError):
            store.run()
    assert store.versions() == [1] and contents(store.merged()) == {"a": b"one two", "b": b"\x00\xff"} and store.listed().count() == 5
    put(tmp_path, "gap", 2, b"y")
    got = store.run()
    assert contents(got) == {"a": b"one two", "b": b"\x00\xff", "gap": b"xyz"} and got.count() == 3
    assert store.versions() == [1, 2] and store.listed().count() == 0
    assert contents(store.run()) == contents(got) and contents(PartStore(spark, f"file://{tmp_path}/none").run()) == {}
