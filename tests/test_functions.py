"""Golden values of scalar functions."""

import random
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from veritrail.functions import evidence, fuzzy, ids, text, units, urls


def one(spark, column, **values):
    """The value of a column over one row of literals."""
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_stable_ids(spark):
    for value in ("doc:1", "Никель", "", "é" * 50):
        assert one(spark, ids.stable_id("entity", F.col("v")), v=value) == f"entity_{uuid.uuid5(uuid.UUID(ids.NAMESPACE), value)}"


def test_cleaning(spark):
    assert one(spark, text.clean_text(F.col("v")), v=" a\x00b\u00adc\r\nd\t  e\rf ") == "a bc\nd e\nf"
    assert one(spark, text.clean_retrieval(F.col("v")), v="a\x01b \t c\n") == "a b c"
    assert one(spark, text.scrubbed(F.col("v")), v="a\"b'c\nd") == "abc d"
    assert one(spark, text.infer_title(F.col("v"), F.lit("file.name.pdf")), v="abc\n  A good title \nmore") == "A good title"
    assert one(spark, text.infer_title(F.col("v"), F.lit("file.name.pdf")), v="abc") == "file.name"
    assert one(spark, text.redacted(F.col("v"), ("Acme Co.",)), v="see C:\\a\\b and bob@x.org doc_12345678 by acme co. now") == "see [REDACTED] and [REDACTED] [REDACTED] by [REDACTED] now"
    assert one(spark, text.safe_file_name(F.col("v")), v="/tmp/" + "Отчёт №1.pdf".encode().decode("latin-1")) == "Отчёт _1.pdf"
    assert one(spark, text.safe_file_name(F.col("v")), v="/tmp/") == "document"


@pytest.mark.parametrize("value, good", [("short", False), ("A readable sentence of words.", True), ("\x01" * 3 + "letters and more letters", False), ("." * 40, False)])
def test_readability(spark, value, good):
    assert one(spark, text.is_readable(F.col("v")), v=value) is good


@pytest.mark.parametrize("value, want", [("", None), ("Привет мир", "ru"), ("hello there", "en"), ("да yes", "mixed"), ("12", "mixed")])
def test_language(spark, value, want):
    assert one(spark, text.infer_language(F.col("v")), v=value) == want


def test_query_tokens(spark):
    got = one(spark, text.graph_tokens(F.col("v")), v="Какие технологии извлечения никеля при 80 NiSO4 the process")
    assert got[:2] == ["niso4", "80"] and "извлеч" in got and "технол" in got and "nickel" in got and "recovery" in got and "the" not in got
    assert one(spark, text.word_tokens(F.col("v")), v="Ab abc ABC d-e_f ёж123") == ["abc", "d-e_f", "ёж123"]
    assert one(spark, text.bm25_query(F.col("v")), v="a bc d-e") == "bc OR d-e"


@pytest.mark.parametrize("query, candidate, score", [("очистка воды", "Очистки водных растворов", 0.5), ("очистка вод", "Очистки воды", 1.0), ("nickel leaching", "leach of copper", 0.5), ("abc", "abd", 0.0), ("", "x", 0.0), ("nickel", None, 0.0)])
def test_match_score(spark, query, candidate, score):
    got = spark.range(1).select(text.text_match_score(F.lit(query), F.lit(candidate).cast("string")).alias("x")).first()["x"]
    assert abs(got - score) < 1e-9


def test_numbers(spark):
    got = one(spark, text.numeric_mentions(F.col("v")), v="at 25,5 °C and 10 mg/l or 7")
    assert [(r["value"], r["unit"]) for r in got] == [(25.5, "°C"), (10.0, "mg/l"), (7.0, None)]
    facts = one(spark, text.numeric_facts(F.col("v")), v="1 2 3 4 5 6 7-9 % 8")
    assert [(f["value_min"], f["value_max"], f["unit"]) for f in facts] == [(1, None, None), (2, None, None), (3, None, None), (4, None, None), (5, None, None), (7, 9, "%")]
    wanted = F.array(F.struct(F.lit(100.0).alias("value"), F.lit("%").alias("unit")))
    assert one(spark, text.numeric_score(wanted, text.numeric_mentions(F.col("v"))), v="about 104") == 1.0
    assert one(spark, text.numeric_score(wanted, text.numeric_mentions(F.col("v"))), v="about 106 and 100 ppm") == 0.0
    for value, want in (("−1,5", -1.5), (" 2e3 ", 2000.0), ("n/a", None), ("1 2", None)):
        assert one(spark, text.parse_number(F.col("v")), v=value) == want
    assert [one(spark, text.comparator(F.col("v")), v=v) for v in ("≈", "≤", "=>", "<", "range")] == ["=", "<=", ">=", "<", "range"]


def test_years_and_clocks(spark):
    year = lambda e, v: spark.range(1).select(text.extract_year(F.lit(e).cast("int"), F.lit(v)).alias("x")).first()["x"]
    assert [year(1999, "2005"), year(5, "in 2005"), year(None, "a12005b"), year(None, "x 1850")] == [1999, 2005, None, None]
    assert one(spark, text.seconds_of(F.lit("01:02:03"))) == 3723 and one(spark, text.clock_of(F.lit(3723))) == "01:02:03"


def test_units(spark):
    rows = spark.createDataFrame([("мг/л",), (" MG / L",), ("°C",), ("kg",), ("blobs",), ("",)], "unit string").withColumn("_x", F.lit(1))
    got = {r["unit"]: (r["symbol"], r["dimension"], r["valid"]) for r in units.normalize(rows, "unit").collect()}
    assert got["мг/л"] == got[" MG / L"] == ("mg/L", "concentration", True) and got["°C"][0] == "degC" and got["kg"][1] == "mass"
    assert got["blobs"] == ("blobs", "unknown", False) and not got[""][2]


def test_classes(spark):
    assert one(spark, text.geography(F.col("v")), v="Russian plants") == "domestic" and one(spark, text.geography(F.col("v")), v="global") == "foreign"
    assert one(spark, text.opposed(F.lit("Rate increases"), F.lit("it DECREASES"))) and not one(spark, text.opposed(F.lit("increase"), F.lit("rise")))
    assert one(spark, text.technology_label(F.lit("Reverse osmosis removes salts"))) == "Reverse osmosis"
    assert one(spark, text.technology_label(F.lit("Способ очистки шахтных вод заключается в обработке"))) == "Способ очистки шахтных вод"
    assert one(spark, text.web_profiles(F.lit("patent on alloy property"))) == ["patents", "properties"] and one(spark, text.web_profiles(F.lit("x"))) == ["journals", "indexes"]
    assert one(spark, text.corpus_route(F.lit("review of x"), F.lit("internal"), 3)) == ["internal_reports", "reviews", "scientific_articles"]
    assert one(spark, text.upload_category(F.lit("Conference Proceedings.pdf"))) == "Материалы конференций" and one(spark, text.upload_category(F.lit("x.pdf"))) == "Статьи"
    assert one(spark, text.supported_slots(["process", "unit", "numeric_value_or_range"], F.lit("leaching at 5"))) == ["process", "numeric_value_or_range"]
    assert one(spark, text.matched_slots(["flow rate", "xy"], F.lit("The RATE"))) == ["flow rate"]
    allowed = ("ChemicalCompound", "Material")
    assert one(spark, text.coerced_label(F.lit("chemical compound"), allowed, "TopicTag")) == "ChemicalCompound"
    assert one(spark, text.coerced_label(F.lit("ChemicalCompound"), allowed, "TopicTag", strict_reference=True)) == "TopicTag"


def test_evidence(spark):
    c = lambda q, s: spark.range(1).select(text.quote_confidence(F.lit(q), F.lit(s), F.lit(0.9)).alias("x")).first()["x"]
    table = "Name\nValue\nUnit\ncopper recovery\n95.2\n%"
    assert c("recovery  95.2", "Recovery 95.2 %") == 0.9 and c("copper recovery value 95.2", table) == 0.7
    assert c("copper recovery value 96.2", table) is None and c("", table) is None
    assert one(spark, text.fact_matches(F.lit("recovery of 95 percent"), F.lit("the recoveries were 96 perc"))) is False
    assert one(spark, text.fact_matches(F.lit("recovery 95 percent"), F.lit("recoveries 95 percents"))) is True
    assert one(spark, evidence.is_direct("Cu and Ni content", F.lit("cu with ni content here"), "broad")) and not one(spark, evidence.is_direct("Cu and Ni content", F.lit("cu only content"), "broad"))
    assert not one(spark, evidence.is_direct("Leaching of nickel", F.lit("leaching of copper"), "broad"))
    for strategy, asked, told, want in (
        ("broad", "какие шламы перерабатывают", "шламы складируют", False), ("broad", "какие шламы перерабатывают", "шламы перерабатывают", True),
        ("broad", "какие шламы", "шламы складируют", True), ("fallback", "какие шламы", "шламы складируют", False), ("broad", "какие", "что угодно", True),
        ("fallback", "XRF assay", "by xrf", True), ("fallback", "XRF assay", "other words", False),
    ):
        assert one(spark, evidence.is_direct(asked, F.lit(told), strategy)) is want, (strategy, asked, told)
    with pytest.raises(ValueError):
        evidence.parse_triples("A,R", ["A"])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return row[-1]


def test_fuzzy_scores(spark):
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 14))) for _ in "xy")
        assert fuzzy.common(a, b) == lcs(a, b)
    assert fuzzy.ratio("abc", "abc") == 100 and fuzzy.partial("ring", "small ring here") == 100
    assert fuzzy.weighted("ring small", "small ring") >= 95 and fuzzy.weighted("nickel", "nickle") >= 80 and fuzzy.weighted("nickel", "cobalt") < 50
    frame = spark.createDataFrame([("a b", "b a"), (None, "x")], "a string, b string")
    got = [r["x"] for r in frame.select(fuzzy.weighted_score(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == 95.0 and got[1] is None
    assert one(spark, fuzzy.nfkc(F.lit("ﬁ"))) == unicodedata.normalize("NFKC", "ﬁ")
    assert one(spark, fuzzy.rouge_l(F.lit("the cat sat"), F.lit("the cat"))) == pytest.approx(0.8)


def test_urls(spark):
    assert one(spark, urls.last_segment(F.lit("https://a/b/c/?x#y"))) == "c" and one(spark, urls.with_scheme(F.lit("a.org"))) == "https://a.org"
    assert one(spark, urls.video_id(F.lit("https://youtu.be/abcdefghijk?t=1"))) == "abcdefghijk"
    assert one(spark, urls.wiki_parts(F.lit("https://en.wikipedia.org/wiki/Nickel_mine"))).asDict() == {"lang": "en", "title": "Nickel_mine"}
    assert one(spark, urls.html_text(F.lit("<p>a&amp;b</p><script>x<y</script> c"))) == "a&b c"


def test_rouge_reads_words_beyond_50000(spark):
    told = spark.range(1).select(F.concat(F.repeat(F.lit("a "), 50_000), F.lit("b c")).alias("x"))
    assert told.select(fuzzy.rouge_l(F.lit("b c"), F.col("x")).alias("y")).first()["y"] == pytest.approx(4 / 50_004)


def test_near_quotes_are_accepted_as_given(spark):
    c = lambda q, s: one(spark, text.quote_confidence(F.lit(q), F.lit(s), F.lit(0.9)))
    assert c("electroextraction temperatures", "the electroextraction temperature, 60 degrees") == 0.9
    assert c("the quick brown fox jumps over lazy dogs again", "we saw the quick brown fox jump over lazy dogs again") == 0.9
    assert c("unrelated words", "the electroextraction temperature") is None


def test_reaches_agrees_with_partial():
    rnd = random.Random(5)
    for _ in range(400):
        b = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        a = list(b[rnd.randint(0, len(b) - 1) :][: rnd.randint(1, 60)])
        for _ in range(rnd.randint(0, 4)):
            a.insert(rnd.randint(0, len(a)), rnd.choice("abc"))
        assert fuzzy.reaches("".join(a), b) is (fuzzy.partial("".join(a), b) >= 95)


def test_facts_are_matched_after_nfkc(spark):
    assert one(spark, text.fact_matches(F.lit("ﬁltration １２ percent"), F.lit("filtration of 12 percent"))) is True
    assert one(spark, text.fact_matches(F.lit("filtration 12"), F.lit("ﬁltration １２"))) is True
