"""Operators that keep an index: posting blocks, annuli of vectors, keys of names; and the keyed state of streams."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import index, names, neighbours, search
from veritrail.streaming import cache, live

# ---- posting blocks -------------------------------------------------------------------------------------------------


def corpus(spark, n=700, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["rare"]
    rows = []
    for i in range(n):
        size = rnd.choice([0, 3, 20, 150])
        text = " ".join(rnd.choices(words, [40 / (k + 1) for k in range(40)] + [0.3], k=size))
        rows.append((i, text, rnd.choice(["a", "b", None])))
    rows += [(n, None, "a"), (n + 1, "rare rare w1", "c"), (None, "w1 w2", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = corpus(spark)
    return docs, index.PostingsIndex.build(docs, f"file://{tmp_path_factory.mktemp('index')}", "doc_id", "text", "source", folders=4)


@pytest.mark.parametrize("terms", [["w0", "w5", "rare"], ["rare"], ["W39", "w38", "nowhere"], ["nowhere"], []])
def test_search_over_blocks_equals_the_scan(spark, built, terms):
    docs, found = built
    want = [(r["doc_id"], round(r["score"], 9)) for r in search.bm25(docs, terms, "doc_id", "text").orderBy(F.desc("score"), "doc_id").limit(15).collect()] if terms else []
    got = [(r["id"], round(r["score"], 9)) for r in found.search(terms, 15).found.orderBy(F.desc("score"), "id").collect()]
    assert got == want


def test_search_by_corpus_equals_the_scan(spark, built):
    docs, found = built
    best = defaultdict(list)
    for r in search.bm25(docs, ["w3", "w9"], "doc_id", "text", keep=["source"]).orderBy(F.desc("score"), "doc_id").collect():
        best[r["source"]].append((r["doc_id"], round(r["score"], 9)))
    got = defaultdict(list)
    for r in found.search(["w3", "w9"], 6, by_group=True).found.orderBy(F.desc("score"), "id").collect():
        got[r["grp"]].append((r["id"], round(r["score"], 9)))
    assert got == {k: v[:6] for k, v in best.items()}


def test_search_skips_blocks_and_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    docs = corpus(spark, 3000, 2)
    found = index.PostingsIndex.build(docs, f"file://{tmp_path}/i", "doc_id", "text", folders=8)
    one = found.search(["w0", "rare"], 5)
    told = one.report.first()
    assert told["terms"] == 2 and 0 < told["blocks_read"] < told["blocks"] / 2 and told["ranges_read"] < told["ranges"]
    want = [r["doc_id"] for r in search.bm25(docs, ["w0", "rare"], "doc_id", "text").orderBy(F.desc("score"), "doc_id").limit(5).collect()]
    assert [r["id"] for r in one.found.orderBy(F.desc("score"), "id").collect()] == want
    plan = found.rows_of(["rare"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder#", "folder#").replace("[(folder", "[folder") or "folder IN" in plan or "folder#" in plan.split("PartitionFilters")[1][:60]
    assert len({f.split("folder=")[1].split("/")[0] for f in found.rows_of(["rare"]).inputFiles()}) == 8  # all that there are
    folder = found.rows_of(["rare"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"].split("folder=")[1].split("/")[0] for r in folder}) == 1


def test_index_is_built_once_for_each_version_of_the_files(spark, tmp_path):
    path = f"{tmp_path}/docs"
    corpus(spark, 30).write.parquet(path)
    first = index.index_of(spark.read.parquet(path), "doc_id", "text")
    assert index.index_of(spark.read.parquet(path), "doc_id", "text").path == first.path
    corpus(spark, 5).write.mode("append").parquet(path)
    assert index.index_of(spark.read.parquet(path), "doc_id", "text").path != first.path


def test_empty_index(spark, built, tmp_path):
    none = index.PostingsIndex.build(built[0].where("false"), f"file://{tmp_path}/e", "doc_id", "text", "source")
    assert none.search(["w1"], 5).found.count() == 0 and none.documents == 0


# ---- nearest neighbours ---------------------------------------------------------------------------------------------


def slow_nearest(queries, vectors, k):
    out = {}
    for q, x in queries:
        scored = []
        for i, y in vectors:
            norm = np.linalg.norm(x) * np.linalg.norm(y)
            scored.append((-round(float(np.dot(x, y)) / norm if norm else 0.0, 12), i))
        out[q] = [(i, pytest.approx(-s, abs=1e-9)) for s, i in sorted(scored)[:k]]
    return out


def found_of(frame):
    out = defaultdict(list)
    for r in frame.orderBy("query_id", F.desc("cosine"), "id").collect():
        out[r["query_id"]].append((r["id"], r["cosine"]))
    return out


@pytest.mark.parametrize("kind", ["even", "clusters", "equal"])
def test_nearest_equals_brute_force(spark, kind):
    rnd = np.random.default_rng(3)
    if kind == "even":
        v = rnd.normal(size=(150, 6))
    elif kind == "clusters":
        v = np.repeat(rnd.normal(size=(6, 8)) * 5, 60, axis=0) + rnd.normal(size=(360, 8)) * 0.2
    else:
        v = np.repeat(rnd.integers(-2, 3, size=(3, 4)), 70, axis=0).astype(float)
    v = np.vstack([v, np.zeros((2, v.shape[1]))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(None, v[0].tolist()), (900, None), (901, [float("nan")] * v.shape[1]), (902, [None] * v.shape[1])]
    frame = spark.createDataFrame(rows + odd, "id long, v array<double>").withColumns({"pivot": F.lit(1), "no": F.lit(2), "d": F.lit(0)})
    every = neighbours.AllNearest(frame, frame, 4, "id", "v", block=16, pivots=12)
    assert found_of(every.found) == slow_nearest([(i, v[i]) for i in range(len(v))], [(i, v[i]) for i in range(len(v))], 4)
    told = every.report.first()
    if kind == "clusters":
        assert told["met"] < 0.5 * told["query_blocks"] * told["vector_blocks"]
    some = neighbours.nearest(frame.where("id % 7 = 0"), frame.where("id % 2 = 1"), 3, "id", "v", block=8)
    assert found_of(some) == slow_nearest([(i, v[i]) for i in range(0, len(v), 7)], [(i, v[i]) for i in range(1, len(v), 2)], 3)
    assert "Cartesian" not in some._jdf.queryExecution().toString()


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert neighbours.nearest(none, none, 3, "id", "v").count() == 0 == neighbours.nearest(some, none, 3, "id", "v").count()
    assert neighbours.nearest(none, some, 3, "id", "v").count() == 0
    assert [tuple(r) for r in neighbours.nearest(some, some, 3, "id", "v").collect()] == [(1, 1, 1.0)]


# ---- duplicate names ------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def slow_groups(rows):
    out = {}
    for i, label, name in rows:
        near = []
        for j, other_label, other in rows:
            if i != j and None not in (label, name, other) and label == other_label:
                a, b = name.lower(), other.lower()
                if a in b or b in a or (len(a) > 5 and edits(a, b) < 3):
                    near.append(j)
        if near:
            out[i] = sorted(set(near))
    return out


def test_duplicate_names_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT", 3)
    monkeypatch.setattr(names, "DELETED", 12)
    rnd = random.Random(6)
    words = []
    for _ in range(45):
        base = "".join(rnd.choice("abc ") for _ in range(rnd.choice([1, 2, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 20, 30])))
        words.append(base)
        for _ in range(rnd.randint(0, 3)):
            other = list(base)
            for _ in range(rnd.randint(1, 3)):
                at = rnd.randrange(len(other) + 1)
                if rnd.random() < 0.5 or not other:
                    other.insert(at, rnd.choice("abcD"))
                else:
                    other.pop(min(at, len(other) - 1))
            words.append("".join(other))
    words += ["", "A", "supplier#000000001", "supplier#000000002", "Supplier#000000001", words[0], words[0].upper(), None]
    rows = [(f"n{k}", rnd.choice(["x", "y"]), w) for k, w in enumerate(words)] + [("z", None, "a"), ("z2", None, "a")]
    got = names.duplicate_groups(spark.createDataFrame(rows, "id string, label string, name string"))
    assert {r["id"]: r["similar"] for r in got.collect()} == slow_groups(rows)
    assert names.duplicate_groups(spark.createDataFrame([], "id string, label string, name string")).count() == 0


def test_equal_names_are_one_class(spark):
    rows = spark.range(400).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("x").alias("label"), F.when(F.col("id") < 398, "one name").otherwise("another thing").alias("name"))
    got = {r["id"]: len(r["similar"]) for r in names.duplicate_groups(rows).collect()}
    assert got == {f"n{i}": 397 if i < 398 else 1 for i in range(400)}


# ---- keyed state ----------------------------------------------------------------------------------------------------


def run(spark, rows, schema, make, tmp_path, cuts):
    """The rows of a stream over files that hold rows cut at these places, one file a micro-batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    edges = [0, *cuts, len(rows)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        part = next((tmp_path / f"w{k}").glob("part-*.parquet"))
        part.rename(folder / f"{k:03d}.parquet")
        import os

        os.utime(folder / f"{k:03d}.parquet", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    with live.state_in_rocksdb(spark):
        live.run_to_table(make(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return spark.read.parquet(f"{tmp_path}/out")


def requests():
    import datetime

    rnd, rows = random.Random(8), []
    at = datetime.datetime(2024, 1, 1)
    for n in range(200):
        at += datetime.timedelta(minutes=rnd.choice([1, 5, 30, 200]))
        rows.append((f"k{rnd.randint(0, 4)}", n, at, f"v{n // 70}", f"answer {n}"))
    return rows, "cache_key string, request long, ts timestamp, version string, answer string"


def test_answer_cache_hits_misses_and_expires_however_the_stream_is_cut(spark, tmp_path):
    rows, schema = requests()
    entries, want = {}, []
    for key, n, at, version, _ in rows:
        made = entries.get(key)
        if made is None:
            why = "first"
        elif (at - made[0]).total_seconds() >= 6 * 3600:
            why = "expired"
        else:
            why = "hit" if made[1] == version else "version"
        if why != "hit":
            entries[key] = (at, version, n)
        want.append((key, n, why, entries[key][2]))
    assert {w[2] for w in want} == {"first", "hit", "expired", "version"}
    batch = cache.answered_batch(spark.createDataFrame(rows, schema), "6 hours")
    assert sorted(map(tuple, batch.collect())) == sorted(want)
    for k, cuts in enumerate(([], [40, 41, 150], list(range(20, 200, 20)))):
        (tmp_path / str(k)).mkdir()
        got = run(spark, rows, schema, lambda s: cache.answered(s, "6 hours"), tmp_path / str(k), cuts)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_runs_stall_and_go_on_however_the_stream_is_cut(spark, tmp_path):
    import datetime

    rnd, rows = random.Random(9), []
    at = datetime.datetime(2024, 1, 1)
    for n in range(120):
        at += datetime.timedelta(minutes=rnd.choice([1, 20, 60]))
        rows.append((rnd.randint(0, 3) if n < 80 else 0, n, rnd.choice(["queued", "judging", "complete"]), at))
    schema, results = "run long, event long, status string, ts timestamp", []
    for k, cuts in enumerate(([], [30, 60, 100], list(range(10, 120, 10)))):
        (tmp_path / str(k)).mkdir()
        results.append(sorted(map(tuple, run(spark, rows, schema, lambda s: cache.watched(s, "2 hours", "1 minute"), tmp_path / str(k), cuts).collect())))
    assert results[0] == results[1] == results[2]
    last = {r[0]: r[2] for r in sorted(results[0], key=lambda r: (r[0], r[3]))}
    assert [last[i] for i in (1, 2, 3)] == ["stalled"] * 3 and last[0] != "stalled"


def test_spacing_follows_rejections(spark, tmp_path):
    rows = [(i % 2, i, i % 5 == 0) for i in range(60)]
    got = run(spark, rows, "worker long, request long, rejected boolean", lambda s: cache.spaced(s, 1.0, 0.5, 2.0), tmp_path, [7, 33])
    want, now = {}, {0: 1.0, 1: 1.0}
    for worker, n, rejected in rows:
        now[worker] = min(2.0, now[worker] * 1.5) if rejected else max(0.5, now[worker] * 0.98)
        want[n] = round(now[worker], 9)
    assert {r["request"]: round(r["seconds"], 9) for r in got.collect()} == want and got.agg(F.max("requests")).first()[0] == 30
