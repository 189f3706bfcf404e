"""Small tables on which the queries of round 4's findings broadcast too much, read part of a table, or shuffled too much."""

import pytest
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_chains_are_not_broadcast(spark):
    from veritrail.llm import components, simhash

    fps = spark.range(50).select(F.xxhash64("id").alias("fp"))
    assert "Broadcast" not in _plan(simhash.candidates(fps))
    rows = fps.select(F.col("fp").alias("key"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("x"))
    for most in (1, 10**6):
        assert "Broadcast" not in _plan(components.joined(rows, fps.select(F.col("fp").alias("key"), F.lit(1).alias("y")), "key", "x", most))


def test_texts_of_pairs_are_not_broadcast(spark):
    from veritrail.llm import shingles

    texts = spark.range(5).select(F.col("id").alias("cls"), F.repeat(F.lit("a b c d e f "), 10).cast("binary").alias("text"))
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    found = shingles.linked(texts, pairs, 5, (4, 5))
    assert "Broadcast" not in _plan(found) and {tuple(r) for r in found.collect()} == {(0, 1), (2, 3)}


def test_what_is_left_of_names_is_not_broadcast(spark):
    from veritrail.operators import names

    rows = spark.range(60).select(F.lit("n").alias("label"), F.concat(F.lit("Supplier#0000"), F.col("id").cast("string")).alias("name"))
    assert "Broadcast" not in _plan(names.near_names(rows, 2))
    assert "Broadcast" not in _plan(names.duplicate_groups(rows.withColumn("id", F.col("name"))))
    # only names that are near leave the join
    assert names.spelt_alike(rows, 2).where(F.levenshtein("name", "other") > 2).count() == 0


def test_pairs_are_counted_before_their_shuffle(spark, monkeypatch):
    from collections import Counter

    from veritrail.operators import graph

    held = {k: {(k * j) % 11 for j in range(k % 5 + 1)} for k in range(30)}
    links = spark.createDataFrame([(i, m) for m, ids in held.items() for i in ids] + [(None, 1), (1, None), (0, 0)], "id long, met long")
    want = Counter((a, b) for ids in held.values() for a in ids for b in ids if a < b)
    found = graph.shared_neighbours(links)
    assert not any("hashpartitioning" in line and "REPARTITION_BY_NUM" in line for line in _plan(found).splitlines())
    for listed in (1000, 2):
        monkeypatch.setattr(graph, "LISTED", listed)
        assert {(r["a"], r["b"]): r["shared"] for r in graph.shared_neighbours(links).collect()} == want


@pytest.mark.parametrize("name", ["f24_quote_verification", "f25_r21_fact_recall", "l2_bm25_many_queries"])
def test_all_items_are_asked(spark, tmp_path, name):
    from veritrail.plans import registry

    said = ["the recovery of nickel reached 95 percent", "a furnace melts 12.5 tons of copper slag"]
    spark.createDataFrame([(k, said[k % 2]) for k in (3, 20, 21)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, f"We saw: {x} here") for k, x in enumerate(said)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["item_id"] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} == {3, 20, 21}
    assert "% 20" not in registry.ORACLE_SQL[name]


def test_quote_keys_miss_no_source(spark):
    from veritrail.functions import text

    quotes = ["ll recovery of nickel reached 9", "recovery of nickel reached 95", "1.5.2 a 3", "x", "..", None, "", "aa bb aa cc dd ee ff gg hh ii", "of nickel reached 95,5 per"]
    texts = ["all recovery of nickel reached 95 percent", "recovery of nickel was reached", "11.5.2 a 3,4", "aa bb zz cc dd ee ff gg hh ii", "bb aa", "of nickel reached 95,55 perhaps", None, ".. x"]
    q = spark.createDataFrame([(x,) for x in quotes], "q string").select("q", text.quote_parts(F.col("q")).alias("a")).withColumn("k", text.quote_keys(F.col("a")))
    s = spark.createDataFrame([(x,) for x in texts], "s string").select("s", text.quote_parts(F.col("s")).alias("b"))
    found = q.crossJoin(s).where(text.parts_confidence(F.col("a"), F.col("b"), F.lit(0.9)).isNotNull())
    rows = found.select(F.col("k").isNull().alias("all"), F.arrays_overlap("k", "b.known").alias("met")).collect()
    assert len(rows) >= 6 and all(r["all"] or r["met"] for r in rows) and not all(r["all"] for r in rows)
