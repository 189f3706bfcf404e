"""Schemas, modes, and what is left of sources and streams."""

import pytest
from pyspark.sql import functions as F

from veritrail import cli, schema
from veritrail.functions.text import vector_literal
from veritrail.operators import modes, retrieval
from veritrail.sources import readers
from veritrail.streaming import live


def test_schemas_make_tables(spark):
    for name in ("CORPORA", "DOCUMENTS", "JOBS", "CHUNKS", "NUMERIC_FACTS", "AGENT_RUNS", "AGENT_EVENTS", "ELEMENTS", "EXTRACTION", "NODES", "EDGES", "QUERY_CACHE", "PIPELINE_RUNS"):
        assert spark.createDataFrame([], getattr(schema, name)).count() == 0
    facts = spark.createDataFrame([(1.0, None, None, "="), (None, None, 2.0, "range"), (None, None, None, "="), (1.0, None, None, "~")], "value double, value_min double, value_max double, comparator string")
    assert schema.invalid_facts(facts).count() == 2
    assert schema.unknown_relations(spark.createDataFrame([("a", "HAS_UNIT", "b"), ("a", "KNOWS", "b")], "src string, rel string, dst string")).count() == 1
    assert schema.bad_vectors(spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "embedding array<float>"), 2).count() == 1
    assert len(set(schema.RELATIONS)) == len(schema.RELATIONS)


def test_modes():
    assert modes.mode_of(None) is modes.MODES["graph_vector_fulltext"] and modes.mode_of("vector", ["d"]).top_k == 5
    with pytest.raises(ValueError):
        modes.mode_of("fulltext", ["d"])


def test_post_processing_order(spark):
    seen = []
    task = lambda name: lambda n, e: (seen.append(name), (n, e))[1]
    frame = spark.range(1)
    modes.post_processed(frame, frame, {"similar": task("similar"), "communities": task("communities")}, ["communities", "similar"])
    assert seen == ["similar", "communities"]
    with pytest.raises(ValueError):
        modes.post_processed(frame, frame, {}, ["x"])


def test_rerank_hook(spark):
    docs = spark.createDataFrame([(i, "license and therefore some readable words", f"s{i % 2}") for i in range(6)], "doc_id long, text string, source string")
    rerank = spark.createDataFrame([(5, 1.0)], "chunk_id long, rerank double")
    scores = {r["chunk_id"]: r["score"] for r in retrieval.cross_corpus_search(docs, rerank=rerank).collect()}
    plain = {r["chunk_id"]: r["score"] for r in retrieval.cross_corpus_search(docs).collect()}
    assert scores[5] != plain[5] and all(scores[k] == plain[k] for k in plain if k != 5)


def test_parsers_and_pages(spark):
    assert readers.parser_of("/a.b/c.PDF") == ".pdf"
    for bad in ("/a.b/c", "x.exe"):
        with pytest.raises(ValueError):
            readers.parser_of(bad)
    rows = [("d", 1, "aa", False), ("d", 2, "", False), ("d", 3, "bb", True), ("d", 4, "c" * 12, False), ("d", 5, "dd", None), ("e", 1, None, False)]
    got = readers.pseudo_pages(spark.createDataFrame(rows, "doc string, position int, text string, page_break boolean"), size=10).orderBy("page_number").collect()
    assert [(r["page_number"], r["text"]) for r in got] == [(1, "aa\nbb"), (2, "c" * 12), (3, "dd")]


def test_status_feed_and_cancel(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "doc long, status string, at long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc long, status string, at long").parquet(str(tmp_path / "in"))
    seen = []
    live.each_batch(stream, lambda rows: seen.extend((r["doc"], r["status"]) for r in rows.collect()), str(tmp_path / "cp"), "doc", "at")
    assert sorted(seen) == [(1, "b"), (2, "c")]
    stream.writeStream.format("noop").queryName("feed").option("checkpointLocation", str(tmp_path / "cp2")).start()
    assert live.cancelled(spark, ["feed", "other"]) == ["feed"]


def test_cli(capsys, spark):
    assert cli.main(["list"]) == 0 and "r1_cross_corpus_search" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "/tmp"]) == 2
    assert spark.range(1).select(vector_literal(F.array(F.lit(0.5), F.lit(-1.0))).alias("x")).first()["x"] == "[0.5,-1]"
