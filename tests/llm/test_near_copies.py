import random

import corpus_pipeline as cp
from veritrail.llm.shingles import distinct, hashes
from veritrail.llm.simhash import near_duplicates


def brute(texts):
    """The least index of each text's component, from all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def sample(n=60):
    rnd, texts = random.Random(3), []
    for _ in range(n):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([3, 30, 120, 400]))]
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 4)):  # each copy is of the one before, so that components are chains
            for _ in range(rnd.randint(0, max(1, len(words) // 35))):
                words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 5000)}"
            texts.append(" ".join(words))
    return texts + [None, "", " \n ", texts[0].upper(), "  " + texts[1]]


def test_components_are_those_of_all_pairs(spark):
    texts = sample()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, shingle=5, similarity=(4, 5)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_stage_drops_a_copy_with_two_of_a_hundred_words_changed(spark, tmp_path):
    words = [f"w{i}" for i in range(100)]
    near, far = list(words), list(words)
    near[30] = near[70] = "new"
    for k in range(5, 100, 12):
        far[k] = "new"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "something else")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in cp.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == {1, 3, 4}


def test_long_texts_are_read_in_blocks():
    words = [f"w{i}".encode() for i in range(300_000)]
    assert len(distinct(list(hashes(b" ".join(words), 5)))) == len(words) - 4


def stage(spark, rows, folder):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, folder).collect()), key=str)


def test_stage_keeps_one_row_of_each_component(spark, tmp_path):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(3, one, "x", "s", 1), (5, one, "x", "s", 1), (5, two, "x", "s", 1), (7, one, None, "s", 1), (7, three, "x", "s", 1),
            (None, three, "x", "s", 1), (None, None, None, None, None), (None, "", None, None, 0), (None, "lone words", None, None, 0)]
    rows += [(9, "the same text again and again", "x", "s", 1)] * 30
    want = [(3, one), (5, two), (7, three), (9, "the same text again and again"), (None, "lone words"), (None, None)]
    got = stage(spark, rows, str(tmp_path))
    assert [(i, t or None) for i, t in got] == sorted(want, key=str)


def test_stage_agrees_with_brute_force(spark, tmp_path):
    texts = sample(25)
    root = brute(texts)
    got = stage(spark, [(i, t, "x", "s", 1) for i, t in enumerate(texts)], str(tmp_path))
    assert [i for i, _ in got] == sorted({*root}, key=str)


def test_changed_copies_make_few_pairs(spark, monkeypatch):
    """A group of copies, each with its own changes, most of them under the bound: no pairs in the square of the group."""
    from veritrail.llm import simhash

    rnd, base, texts = random.Random(5), [f"b{i}" for i in range(90)], []
    for k in range(240):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 6])):
            words[rnd.randrange(90)] = f"n{k}x{rnd.randint(0, 999)}"
        texts.append(" ".join(words))
    seen, own = [], simhash.linked
    monkeypatch.setattr(simhash, "linked", lambda texts, pairs, *rest: (seen.append(pairs.count()), own(texts, pairs, *rest))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, shingle=5, similarity=(4, 5)).collect()}
    assert got == dict(enumerate(brute(texts))) and len(set(got.values())) > 40
    assert sum(seen[1:]) < 240 * 10, seen


def test_components_are_the_same_where_large_buckets_are_dealt_in_parts(spark, monkeypatch):
    from veritrail.llm import simhash

    monkeypatch.setattr(simhash, "HOT", 2)
    texts = sample(25)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, shingle=5, similarity=(4, 5)).collect()}
    assert got == dict(enumerate(brute(texts)))
