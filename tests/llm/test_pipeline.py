import random

import corpus_pipeline as cp
from veritrail.llm.simhash import fingerprint

LANGS = {"aa": ["the", "and", "thing", "with", "that"], "bb": ["der", "und", "nicht", "über", "ich"]}


def corpus(spark, folder, n=240):
    rnd = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        lang = rnd.choice(list(LANGS))
        words = [rnd.choice(LANGS[lang]) + str(rnd.randint(0, 40) or "") for _ in range(90)]
        good = i % 5 > 0
        text = " ".join(words if good else [w + "%%%" for w in words])
        docs.append((i, text, lang, f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(1000, docs[1][1], "aa", "s1", 1), (1001, docs[1][1], "aa", "s1", 1), (1002, None, "aa", "s1", 0), (1003, "12 34 !", None, None, 7), (None, docs[2][1], None, None, 5), (3, docs[3][1], "aa", "s3", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_each_stage_does_its_part(spark, tmp_path):
    folder = str(tmp_path)
    docs = corpus(spark, folder)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = now.columns, []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/stage{k}")
        now = spark.read.parquet(f"{folder}/stage{k}")
        kept.append(now.collect())
        if k < len(cp.STAGES) - 1:
            assert now.columns == columns, name
    language, quality, unique, mixed, coded = kept
    assert len(language) == len(docs) - 2 and not {1002, 1003} & {r["doc_id"] for r in language}
    assert all("%" not in r["text"] for r in quality) and len(quality) == sum("%" not in (d[1] or "%") for d in docs if d[0] != 1003)
    ids = [r["doc_id"] for r in unique]
    assert not {1000, 1001} & set(ids) and 1 in ids and ids.count(3) == 1
    prints = [fingerprint(r["text"].encode()) for r in unique if r["doc_id"] is not None]
    assert all(bin(a ^ b).count("1") > 4 for i, a in enumerate(prints) for b in prints[:i])
    texts = {r["text"] for r in unique}
    assert {r["text"] for r in mixed} <= texts and max(map([r["doc_id"] for r in mixed].count, {r["doc_id"] for r in mixed})) <= 3
    assert len(coded) == len(mixed)


def test_run_applies_the_stages(spark, tmp_path):
    corpus(spark, str(tmp_path), 100)
    assert cp.run(spark, str(tmp_path)).count() > 30
    spark.read.parquet(f"{tmp_path}/documents.parquet").where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").where("false").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
