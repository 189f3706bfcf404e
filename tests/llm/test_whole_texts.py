"""Filter audit, fill-in-the-middle, and substring deduplication by recompression."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.llm import filter_audit as fa
from veritrail.llm import fim
from veritrail.llm import recompression as rc

SPACES = " \t\n\v\f\r"
ODD = [None, "", " \n", "one", "É dé  ", " a b ", "x<P>y", "w " * 12 + "w", "same " * 40, "A" * 300]


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            out, word = ([*out, word] if word else out), ""
        else:
            word += c
    return [*out, word] if word else out


# ---- filter audit -------------------------------------------------------------------------------------------------


def slow_audit(rows, labels):
    """rows: (id, text, part); labels: id -> (good, toxic)."""
    masks = []
    for i, text, part in rows:
        t, w = text or "", split(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        masks.append((part or "", {f for f, x in fails.items() if x}, *labels.get(i, (False, False))))
    out, removed = {}, Counter()
    for order in permutations("ABCDE"):
        for k, f in enumerate(order):
            for part, fails, good, toxic in masks:
                got = out.setdefault((part, "".join(order), k + 1), [0] * 6)
                gone, fail = bool(fails & set(order[:k])), f in fails
                got[0] += not gone and not fail
                got[1] += fail and not gone
                got[2] += fail and gone
                got[3] += fails == {f}
                got[4] += fail and not gone and good
                got[5] += fail and not gone and toxic
                removed[part, f] += fail and not gone
    return sorted((*key, *got, removed[key[0], key[1][key[2] - 1]]) for key, got in out.items())


def audit_rows():
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randint(0, 900)}" for _ in range(n)) for n in (10, 199, 200, 201, 260, 300)]
    texts += [texts[3] + " #", texts[4][:-1] + "Q", texts[4][:70] + "Z" + texts[4][71:], "Big " * 250, "é" * 5, "É" * 5, *ODD]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in range(150)]
    return rows + [(None, texts[3], "en"), (None, texts[3], "de"), (7, rows[7][1], "en"), rows[9], (9, "other text of nine", "de")]


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("part", "mask", "id", "blocks", "digest", "cls", "n")})
    given = [(i, i % 3 % 2, int(i % 7 == 0)) for i in range(0, 150, 2)] + [(2, 1, None), (2, None, 1), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    told = {}
    for i, good, toxic in given:
        old = told.get(i, (False, False)) if i is not None else (False, False)
        told[i] = (old[0] or good == 1, old[1] or toxic == 1)
    told.pop(None)
    got = fa.filter_audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == slow_audit(rows, told)
    assert fa.filter_audit(docs.where("false"), labels).count() == 0


def test_equal_hashes_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fa, "block_hashes", lambda data: [0] if data else [])
    rows = [(i, t, "a") for i, t in enumerate(["ab", "cd", "ab", "cd", "ef", "abc", ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = fa.duplicates(docs, fa.signed(docs, "doc_id", "text", "lang"), "doc_id", "text")
    assert {r["id"] for r in found.collect()} == {2, 3}


def test_words_and_blocks_of_long_texts(monkeypatch):
    text = (" ".join(f"word{i % 700}" for i in range(9000)) + "\n\té ").encode()
    whole = fa.word_counts(text)
    monkeypatch.setattr(fa, "_PART", 100)
    assert fa.word_counts(text) == whole == (9001, 701)
    assert len(fa.block_hashes(text)) == 5 and fa.block_hashes(b"") == []
    assert fa.block_hashes(text) != fa.block_hashes(text[:-1] + b"!") and fa.block_hashes(text)[0] == fa.block_hashes(text[:64])[0]


def test_a_hot_text_is_one_class(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("cold "), "id")).alias("text"), F.lit("x").alias("lang"))
    failed = fa.failures(docs)
    assert failed.where(F.col("mask").bitwiseAND(fa.DUPLICATE) > 0).agg(F.sum("n")).first()[0] == 1999
    assert failed.agg(F.sum("n")).first()[0] == 3000


# ---- fill in the middle ---------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=300))
def test_elias_fano_gives_each_number_back(gaps):
    values = np.cumsum(gaps)
    packed = fim.EliasFano.of(values).packed()
    index = fim.EliasFano.unpacked(packed)
    assert [index.select(k) for k in range(index.n)] == values.tolist()
    assert len(packed) <= 24 + len(values) * (2 + np.log2(values[-1] / len(values) + 1)) / 8 + 20


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é  \t\n\r<P>"), max_size=60))
def test_boundaries_are_those_of_the_expression(text):
    import regex

    ends = [m.end() for m in regex.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    assert [len(text.encode()[:b].decode()) for b in fim.boundaries(text.encode()).tolist()] == ends


def test_boundaries_over_blocks(monkeypatch):
    data = (" ab  é\n" * 50 + "  ").encode()
    whole = fim.boundaries(data).tolist()
    monkeypatch.setattr(fim, "_BLOCK", 7)
    assert fim.boundaries(data).tolist() == whole
    assert fim.boundaries(b"").tolist() == []


def slow_fim(doc_id, text):
    import regex

    t = text or ""
    units = regex.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in fim.MARKERS) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, t
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = [*ODD, "a <S", "<P", "long  text é " * 5000, *("".join(rnd.choice("aé b\n\t ") for _ in range(rnd.randint(1, 80))) for _ in range(40))]
    rows = [(i, rnd.choice(texts)) for i in range(300)] + [(None, "some text here"), (None, None), (5, "again five"), (5, "again five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "key", "form", "output", "entry", "draw", "n")})
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out]
    assert Counter(got) == Counter((i, *slow_fim(i, t)) for i, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert Counter((r["doc_id"], r["back"]) for r in out) == Counter((i, t or "") for i, t in rows)
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_each_repeated_text_is_indexed_once(spark):
    texts = spark.createDataFrame([("a b",)] * 500 + [("c",)] * 3, "text string")
    assert sorted(bytes(r["text"]) for r in fim.index_of(texts).collect()) == [b"a b", b"c"]


# ---- recompression --------------------------------------------------------------------------------------------------


def slow_removal(rows, window=rc.WINDOW):
    """(id, words, removed, kept text) of each of rows (id, text); null ids are larger than others."""
    order, first = lambda i: (i is None, i or 0), {}
    words = [split(t) for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < order(i) for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return out


def passages(words, n, seed):
    rnd = random.Random(seed)
    base, texts = [f"w{rnd.randrange(words)}" for _ in range(500)], []
    for _ in range(n):
        own = [f"w{rnd.randrange(words)}" for _ in range(rnd.choice([0, 1, 12, 13, 14, 50, 200]))]
        for _ in range(rnd.randint(0, 2)):
            at, place = rnd.randrange(400), rnd.randrange(len(own) + 1)
            own[place:place] = base[at : at + rnd.choice([10, 12, 13, 14, 15, 20, 60])]
        if rnd.random() < 0.2:
            place = rnd.randrange(len(own) + 1)
            own[place:place] = ["run"] * rnd.choice([2, 3, 4, 5, 13, 14, 30, 200])
        texts.append(rnd.choice(SPACES).join(own))
    return texts


@pytest.mark.parametrize("words", [1, 2, 4, 30, 3000])
def test_removed_words_are_those_of_all_windows(spark, words):
    texts = passages(words, 50, words)
    rows = [(i, t) for i, t in enumerate(texts + ODD + texts[:3])]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "copy", "at", "key", "doc", "ats", "symbol")})
    assert Counter(map(tuple, rc.without_repeats(docs).collect())) == Counter(slow_removal(rows))


def test_repeated_and_null_ids(spark):
    texts = passages(200, 12, 3)
    rows = [(i % 4 if i % 5 else None, t) for i, t in enumerate(texts)] + [(1, texts[0]), (1, texts[0]), (None, texts[2]), (3, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, rc.without_repeats(docs).collect())) == Counter(slow_removal(rows))
    assert rc.without_repeats(docs.where("false")).count() == 0


def test_long_texts_lose_the_same_words_in_pieces(spark, monkeypatch):
    texts = [" ".join(passages(60, 40, 8)), " ".join(passages(60, 30, 8)), "x" * 5000 + " " + " ".join(["y"] * 40)] * 2
    spans = [part for part in rc.pieces([t.encode() for t in texts], 13)]
    assert len(spans) == 1
    monkeypatch.setattr(rc, "PIECE", 300)
    found = {}
    for data, first, stop, text, number in rc.pieces([t.encode() for t in texts], 13):
        symbol, _, at, size = rc.blocks(rc.word_names(data, first, stop), text)
        for s, a, n in zip(symbol.tolist(), at.tolist(), size.tolist()):
            for k in range(n):
                words = tuple(texts[text[a]].split()[number[a] + k :][:13])
                assert found.setdefault(words, s) == s  # a window's symbol depends on its words alone
    rows = list(enumerate(texts))
    want = slow_removal(rows)
    places = {i: rc.kept(t.encode(), None)[:2] for i, t in rows}
    assert {i: (n, 0) for i, n, _, _ in want} == places


def test_a_hot_passage_is_dealt_out(spark):
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{i}a {i}b {common} {i}z" if i % 3 else f"own{i} text") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = rc.symbols(docs.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("copy"), F.col("text").cast("binary").alias("text")))
    sizes = [r["n"] for r in found.groupBy("one", "part").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 60  # of 600 documents that have it
    removed = {r["doc_id"]: r["n_removed"] for r in rc.without_repeats(docs).collect()}
    assert removed == {i: 40 if i % 3 and i > 1 else 0 for i, _ in rows}
