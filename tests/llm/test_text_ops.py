"""Language ID, quality classifier, quality rules, token counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import langid, mil
from veritrail.llm.common import held_out
from veritrail.llm.quality_rules import ALPHA, SIGNALS, judged, measured, quantiles, sketches
from veritrail.llm.token_counts import Counter, Sections, attributed, lines, token_counts

TOKENIZER = pytest.importorskip("public_tokenizers")
EMPTY = "doc_id long, text string, lang string, source string"


def speak(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."


LANGS = {"aa": ["the", "and", "thing", "with", "that"], "bb": ["der", "und", "nicht", "über", "ich"], "cc": ["que", "ción", "para", "los", "año"]}


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(1)
    rows = [(i, speak(rnd, LANGS[lang := rnd.choice(list(LANGS))], rnd.randint(3, 60)), lang, f"s{i % 3}") for i in range(400)]
    return spark.createDataFrame(rows, EMPTY)


def test_language_id_on_held_out(spark, corpus):
    model = langid.train(corpus.where(~held_out(F.col("doc_id"))))
    got = langid.predict(corpus.where(held_out(F.col("doc_id"))), model).toPandas()
    assert len(got) > 40 and (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_id_odd_rows(spark, corpus):
    model = langid.train(corpus)
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "the and that"), (None, "der und nicht"), (4, "the and that"), (5, "der und " * 40_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang_pred": F.lit("clash"), "score": F.lit("clash"), "id": F.lit(1)})
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).orderBy("doc_id").collect()]
    assert got == [(None, "bb"), (1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa"), (5, "bb")]
    assert langid.predict(odd.where("false"), model).count() == 0
    nothing = langid.train(corpus.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_sample_is_bounded_and_stable(spark, corpus):
    rows = corpus.select("lang", "doc_id", "text")
    picked = langid.sampled(rows, "lang", 20, ["doc_id", "text"])
    assert {r["count"] for r in picked.groupBy("lang").count().collect()} == {20}
    assert sorted(map(tuple, picked.collect())) == sorted(map(tuple, langid.sampled(rows.repartition(7), "lang", 20, ["doc_id", "text"]).collect()))
    same = langid.sampled(rows.unionByName(rows), "lang", 20, ["doc_id", "text"])  # repeated rows are drawn once
    assert same.count() == same.distinct().count() > 0


def test_no_language_or_label_is_lost_to_repeated_or_null_rows(spark):
    """200,000 equal rows, or as many null texts, beside 60 documents of the same and 60 of another group."""
    rnd = random.Random(4)
    some = [(i, speak(rnd, LANGS["aa" if i % 2 else "bb"], 40), "aa" if i % 2 else "bb") for i in range(120)]
    good = spark.createDataFrame(some, "doc_id long, text string, lang string")
    flood = lambda text: spark.range(200_000).select(F.lit(999).cast("long").alias("doc_id"), F.lit(text).cast("string").alias("text"), F.lit("bb").alias("lang"))
    for text in ("der und nicht", None):
        rows = good.unionByName(flood(text))
        model = langid.train(rows)
        assert model.languages == ["aa", "bb"]
        got = langid.predict(good, model).toPandas()
        assert (got["lang"] == got["lang_pred"]).all()
        picked = langid.sampled(rows.where("text IS NOT NULL"), "lang", 1500, ["doc_id", "text"])
        assert picked.count() == 120 + (text is not None)
    labels = good.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).unionByName(spark.createDataFrame([(999, 0)], "doc_id long, quality int"))
    for text in ("der und nicht", None):
        drawn = mil.drawn(good.unionByName(flood(text)), labels)
        assert {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()} == {0: 60 + (text is not None), 1: 60}


def test_language_id_learns_from_null_and_repeated_ids(spark, corpus):
    for ids in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        rows = corpus.withColumn("doc_id", ids)
        model = langid.train(rows, per_language=50)
        got = langid.predict(corpus, model).toPandas()
        assert model.languages == sorted(LANGS) and (got["lang"] == got["lang_pred"]).mean() > 0.95
    many = spark.createDataFrame([(i, f"q{i} text of language {i}", f"l{i:04d}") for i in range(700)], "doc_id long, text string, lang string")
    model = langid.train(many)
    assert len(model.languages) == 700 and model.buckets < langid.BUCKETS and model.log_prob.nbytes <= langid.MATRIX_BYTES


def test_language_scores_by_brute_force(spark, corpus):
    rows = [r for r in corpus.collect() if len(r["text"]) < 60][:30]
    model = langid.train(spark.createDataFrame(rows, EMPTY))

    def grams(text):
        points = [ord(c) for c in f" {text.lower()} "]
        for order in langid.ORDERS:
            for i in range(len(points) - order + 1):
                value = order
                for p in points[i : i + order]:
                    value = (value ^ p) * 2654435761 % 2**32
                    value ^= value >> 15
                yield value % langid.BUCKETS

    counts = {name: {} for name in sorted({r["lang"] for r in rows})}
    for r in rows:
        for g in grams(r["text"]):
            counts[r["lang"]][g] = counts[r["lang"]].get(g, 0) + 1
    for text in [r["text"] for r in rows[:8]] + ["the und que", "xyz"]:
        n, logs = len(list(grams(text))), []
        for name, own in counts.items():
            total = sum(own.values()) + 0.1 * langid.BUCKETS
            prior = sum(r["lang"] == name for r in rows) / len(rows)
            logs.append(np.log(prior) + sum(np.log((own.get(g, 0) + 0.1) / total) for g in grams(text)))
        z = np.array(logs) * min(1, langid.SHARP / n)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        (name,), (score,) = model.scores([text])
        assert name == list(counts)[int(p.argmax())] and abs(score - p.max()) < 1e-3


def test_long_texts_are_hashed_whole():
    model = langid.Model(["a", "b"], np.ones((langid.BUCKETS, 2)), np.ones(2))
    text = "x" * (2 * langid._CHARS + 5)
    _, size = model.sums([text])
    assert size[0] == sum(len(text) + 2 - order + 1 for order in langid.ORDERS)


def test_quality_gradient_is_that_of_the_loss():
    rnd = np.random.default_rng(0)
    model = mil.Model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    bags, labels = [rnd.random((n, mil.FEATURES)) for n in (1, 3, 5)], np.array([0.0, 1.0, 1.0])

    def loss():
        total = 0.0
        for x, y in zip(bags, labels):
            h, _, _, logit = model.instances(x)
            a = np.exp(logit - logit.max())
            a /= a.sum()
            p = mil._sigmoid((a @ h) @ model.p["c"] + model.p["b"][0])
            total -= y * np.log(p) + (1 - y) * np.log(1 - p)
        return total / len(bags)

    grad = model.gradient(bags, labels)
    for name, value in model.p.items():
        at = tuple(rnd.integers(0, s) for s in value.shape)
        keep = value[at]
        value[at] = keep + 1e-5
        up = loss()
        value[at] = keep - 1e-5
        down = loss()
        value[at] = keep
        assert abs((up - down) / 2e-5 - np.asarray(grad[name])[at]) < 1e-6


def test_quality_classifier_learns_and_takes_odd_rows(spark):
    rnd = random.Random(2)
    good = lambda: speak(rnd, LANGS["aa"], 80)
    bad = lambda: " ".join(w + "%%%" for w in speak(rnd, LANGS["aa"], 80).split())
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 200)] + [(7, 0), (8, None), (9, 5), (None, 1)], "doc_id long, quality int")
    model = mil.train(docs, labels)
    got = mil.score(docs.where("doc_id >= 200").withColumns({"score": F.lit("clash"), "label": F.lit(1)}), model).toPandas()
    assert ((got["score"] >= 0.3) == (got["doc_id"] % 3 > 0)).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "the and"), (None, "the and"), (3, "the thing " * 60_000)], "doc_id long, text string")
    scores = [r["score"] for r in mil.score(odd, model).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert mil.score(odd.where("false"), model).count() == 0
    assert mil.train(docs, labels.where("false")).constant == 0.5
    assert mil.train(docs.where("false"), labels).constant == 0.5


def test_quality_scores_by_brute_force():
    rnd = np.random.default_rng(3)
    model = mil.Model()
    p = {k: v.astype(float) for k, v in model.p.items()}
    for text in (b"Some words, and 12 of them.\n" * 40, b"%%% $$$", b"", bytes(rnd.integers(32, 127, 1234).astype(np.uint8))):
        hs, logits = [], []
        for row in mil.encoded(mil.passages(text)).astype(float):
            h = [np.tanh(sum(row[i] * p["E"][i, j] for i in range(mil.FEATURES)) + p["e"][j]) for j in range(mil.HIDDEN)]
            gate = 0.0
            for k in range(mil.GATE):
                v, u = sum(h[j] * p["V"][j, k] for j in range(mil.HIDDEN)), sum(h[j] * p["U"][j, k] for j in range(mil.HIDDEN))
                gate += p["w"][k] * np.tanh(v) / (1 + np.exp(-u))
            hs.append(h), logits.append(gate)
        weights = np.exp(logits) / np.exp(logits).sum()
        z = p["b"][0] + sum(w * sum(h[j] * p["c"][j] for j in range(mil.HIDDEN)) for w, h in zip(weights, hs))
        assert abs(model.scores([text])[0] - 1 / (1 + np.exp(-z))) < 1e-4


def test_quality_training_is_bounded_by_rows(spark):
    rnd = random.Random(3)
    rows = [(i % 4, speak(rnd, LANGS["aa"], 30) + ("%%%" * 9 if i % 4 > 1 else "")) for i in range(800)] + [(5, "x " * 100_000), (6, "y " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(4)] + [(5, 1), (6, 0)], "doc_id long, quality int")
    picked = mil.drawn(docs, labels, per_label=10).collect()
    assert 2 <= len(picked) <= 20 and {r["label"] for r in picked} == {0, 1}  # ids name 200 rows each; long texts aren't drawn
    model = mil.train(docs, labels, per_label=100)
    good, bad = model.scores([speak(rnd, LANGS["aa"], 30).encode(), b"%%%" * 30])
    assert good > bad
    assert mil.train(docs.where("doc_id > 4"), labels).constant == 0.5


def test_batching_does_not_change_scores():
    rnd = random.Random(4)
    model = mil.Model()
    texts = [speak(rnd, LANGS["cc"], n).encode() for n in (1, 500, 30, 20_000, 2)]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts], atol=1e-6)


def slow_counts(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines_, seen, dup = text.split("\n"), set(), 0
    for line in lines_:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_rule_counts_by_brute_force(spark):
    rnd = random.Random(6)
    texts = [None, "", " \n\t", "a b c a b c", "a a a a a", "é x\x0by\n\nz|<>\n z|<>", "one\ntwo\none\n\n \n \none"]
    texts += [rnd.choice([" ", "\n"]).join(rnd.choice("ab cd é $ %%% x".split()) for _ in range(rnd.randint(1, 80))) for _ in range(60)]
    rows = [(i, t, None if i % 5 == 0 else "aa", None if i % 7 == 0 else "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, EMPTY).withColumns({"id": F.lit(1), "g0": F.lit(2), "t": F.lit(3), "w": F.lit(4)})
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in measured(docs).collect()}
    assert got == {i: slow_counts(t) for i, t in enumerate(texts)}
    kept = judged(docs).collect()
    assert len(kept) == len(rows) and not any(r["kept"] and r["base_failed"] for r in kept)
    assert judged(docs.where("false")).count() == 0


def test_sketch_quantiles_and_merge(spark):
    rnd = random.Random(8)
    values = [int(rnd.lognormvariate(3, 1)) for _ in range(3000)]
    rows = spark.createDataFrame([("a" if i % 2 else "b", v) for i, v in enumerate(values)], "g string, v long")
    parts = sketches(rows, ["g"], ["v"])
    merged = parts.groupBy("signal", "bucket").agg(F.sum("n").alias("n"))
    whole = sketches(rows.withColumn("g", F.lit("all")), ["g"], ["v"]).select("signal", "bucket", "n")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    got = quantiles(merged, [], {"q10": 10, "q50": 50, "q99": 99}).first()
    gamma = (1 + ALPHA) / (1 - ALPHA)
    for name, q in (("q10", 10), ("q50", 50), ("q99", 99)):
        exact = sorted(values)[-(-q * len(values) // 100) - 1]
        estimate = 2 * gamma ** (got[name] - 1) / (gamma + 1) if got[name] else 0
        assert abs(estimate - exact) <= 1.01 * ALPHA * exact + 1e-9


def quality_rows():
    """Source s: short words; source t: long ones, of which a text of short ones stands out, and the reverse."""
    rnd = random.Random(10)
    short = [a + b for a in "bcdfg" for b in "aeiou"] + [f"{a}{b}r" for a in "klmn" for b in "aeiou"]
    made = lambda words, n: " ".join("".join(rnd.choice(words) for _ in range(k)) + rnd.choice(["", "", "", ","]) for k in rnd.choices([1, 2, 3] if words is short else [5, 6, 7], k=n))
    long = short + ["ston"]
    rows = [(i, made(short, 120) + ".", "aa", "s") for i in range(80)] + [(100 + i, made(long, 120) + ".", "aa", "t") for i in range(80)]
    rows += [(300, rows[0][1], "aa", "t"), (301, rows[80][1], "aa", "s"), (302, " ".join(w + "$$$" for w in rows[1][1].split()), "aa", "s"), (303, rows[2][1], None, None), (304, None, None, "s")]
    return rows


def test_symbols_are_junk_where_they_are_rare_only(spark):
    rnd = random.Random(11)
    text = lambda share: " ".join(rnd.choice(["some", "plain", "words", "here", "now"]) + rnd.choice("abc") + ("|" if rnd.random() < share else rnd.choice([",", "", "", ""])) for _ in range(120)) + ".\n"
    rows = [(i, text(0), "aa", "prose") for i in range(60)] + [(100 + i, text(rnd.uniform(0.2, 0.4)), "aa", "tables") for i in range(60)] + [(200, text(0.3), "aa", "prose"), (201, text(0.02), "aa", "prose")]
    kept = {r["doc_id"]: r["kept"] for r in judged(spark.createDataFrame(rows, EMPTY)).collect()}
    assert not kept.pop(200) and all(kept.values())


def test_the_same_text_is_kept_in_one_source_and_dropped_in_another(spark):
    found = judged(spark.createDataFrame(quality_rows(), EMPTY)).collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert kept[0] and kept[100] and not kept[300] and not kept[301] and not kept[302] and kept[303] and not kept[304]
    assert sum(v for d, v in kept.items() if d < 300) >= 156
    fences = {(r["g1"], *(r[f"{side}_{s}"] for s in SIGNALS for side in ("low", "high"))) for r in found if r["g1"]}
    one, other = (next(f for f in fences if f[0] == s) for s in "st")
    assert all(a != b for a, b in zip(one[:3], other[:3]))


def test_equal_documents_of_a_group_do_not_reject_the_others(spark):
    rows = [r for r in quality_rows() if r[0] < 200]
    rows += [(500 + i, rows[5][1], "aa", "s") for i in range(900)]  # over half of the group is one text
    kept = {r["doc_id"]: r["kept"] for r in judged(spark.createDataFrame(rows, EMPTY)).collect()}
    assert sum(kept[i] for i in range(80)) >= 60 and all(kept[500 + i] for i in range(900))


def test_very_long_texts_are_measured_whole(spark):
    text = "one two\nthree " * 60_000 + "%%% end"
    got = measured(spark.createDataFrame([(1, text, None, None)], EMPTY)).first()
    assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow_counts(text)


def test_token_counts_match_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["Hello wörld\n\nthis is é \U0001f600 text\nand more  words\n", "one line", "\n\n a\n", "日本語のテキスト\nzwei", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("section", F.lit("clash"))
    got = {}
    for r in token_counts(docs, TOKENIZER.path("byte_bpe_50k.tiktoken"), TOKENIZER.PATTERN).collect():
        got[r["doc_id"], r["section_no"]] = r["n_tokens"]
    for k, text in enumerate(texts):
        encoded = t.encode(text, add_special_tokens=False)
        sections = lines(text)
        want = [0] * len(sections)
        for a, _ in encoded.offsets:
            want[next(i for i, (s, e) in enumerate(zip(sections.first, sections.stop)) if s <= a < e)] += 1
        assert [got[k, i] for i in range(len(sections))] == want, text


def test_attribution_rules_conserve_tokens():
    rnd = random.Random(12)
    for _ in range(200):
        n = rnd.randint(1, 40)
        cuts = sorted({0, n, *(rnd.randint(0, n) for _ in range(12))})
        first, stop = np.array(cuts[:-1]), np.array(cuts[1:])
        sections = [("s", a := rnd.randint(0, n), rnd.randint(a, n)) for _ in range(rnd.randint(0, 4))]
        owner = [next((k for k, (_, a, b) in enumerate(sections) if a <= c < b), len(sections)) for c in range(n)]
        for rule in ("start", "most", "share"):
            counts, crossing = attributed(first, stop, n, Sections.of(sections, n), rule)
            want = np.zeros(len(sections) + 1)
            for a, b in zip(first, stop):
                own = owner[a:b]
                if rule == "start":
                    want[own[0]] += 1
                elif rule == "most":
                    want[max(dict.fromkeys(own), key=own.count)] += 1
                else:
                    for o in own:
                        want[o] += 1 / len(own)
            assert np.allclose(counts, want) and abs(counts.sum() - len(first)) < 1e-9


def test_long_texts_are_encoded_in_blocks(monkeypatch):
    from veritrail.llm import bpe, token_counts as tc

    data = open(TOKENIZER.path("byte_bpe_50k.tiktoken"), "rb").read()
    counter = Counter(bpe.read_ranks(data.split(b"\n")), TOKENIZER.PATTERN)
    text = "Some words, 12 of them \U0001f600 é\n\n  more " * 40
    whole = counter.spans(text)
    monkeypatch.setattr(tc, "blocks", lambda t: bpe.blocks(t, 37))
    assert len(list(bpe.blocks(text, 37))) > 20 and all(np.array_equal(a, b) for a, b in zip(whole, counter.spans(text)))


def test_attribution_of_very_many_lines(spark):
    import time

    began = time.perf_counter()
    text = "\n" * 2_000_000 + "end of it\n\n" * 100_000
    docs = spark.createDataFrame([(1, text), (2, "a\n\n\nb")], "doc_id long, text string")
    counter = Counter(read_ranks_of(), TOKENIZER.PATTERN)
    for rule in ("start", "share"):
        found = token_counts(docs, TOKENIZER.path("byte_bpe_50k.tiktoken"), TOKENIZER.PATTERN, rule=rule).where("doc_id = 1")
        n, total = found.agg(F.count("*"), F.sum("n_tokens")).first()
        assert n == 2_200_000 and abs(total - len(counter.spans(text)[0])) < 1e-6 * n
    assert time.perf_counter() - began < 120


def read_ranks_of():
    from veritrail.llm.bpe import read_ranks

    return read_ranks(open(TOKENIZER.path("byte_bpe_50k.tiktoken"), "rb").read().split(b"\n"))


def test_token_counts_with_given_sections_and_odd_rows(spark):
    rows = [(1, "title here body follows", [("title", 0, 10), ("body", 11, 999)]), (2, None, None), (3, "", [("x", 0, 5)]), (None, "abc", []), (4, "abc def", [("x", None, 3), None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<name:string,start:int,end:int>>")
    got = token_counts(docs, TOKENIZER.path("byte_bpe_50k.tiktoken"), TOKENIZER.PATTERN, sections_col="s", rule="share")
    total = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    counter = Counter({k: v for k, v in __import__("veritrail.llm.bpe", fromlist=["x"]).read_ranks(open(TOKENIZER.path("byte_bpe_50k.tiktoken"), "rb").read().split(b"\n")).items()}, TOKENIZER.PATTERN)
    assert abs(total[1] - len(counter.spans(rows[0][1])[0])) < 1e-9 and abs(total[None] - 1) < 1e-9 and total[3] == 0 and 2 not in total
    assert token_counts(docs.where("false"), TOKENIZER.path("byte_bpe_50k.tiktoken"), TOKENIZER.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts(docs, TOKENIZER.path("byte_bpe_50k.tiktoken"), TOKENIZER.PATTERN, rule="none")
