"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets counts (words, symbols, letters, repeated lines, repeated word windows) and, from them, signals as whole
numbers: the mean length of words, the share of characters that are no letters, the words of a line, the symbols in a
hundred words (and SHIFT more, so that few symbols where there are none otherwise are no great ratio). For each language
and source the distribution of each signal over the documents that pass the base rules is kept as a mergeable quantile
sketch: logarithmic buckets of relative width 2 * ALPHA with a count each, so that partial sketches merge by adding counts
and a quantile's relative error is at most ALPHA. Fences are read from the group's own sketch, in buckets (that is, as
ratios):

    high = median + REACH * max(75 % quantile - median, pooled, least)
    low  = median - REACH * max(median - 25 % quantile, pooled, least)

where least is a bucket (a tenth for symbols) and pooled is the median of that spread over the groups of MIN_GROUP documents or more, whatever their sizes; it keeps a
group of mostly equal documents from rejecting all others. A group under MIN_GROUP documents reads the merged sketch of all groups instead. No fixed
cutoff enters. A document is kept if it passes the fixed base rules and each signal lies within its group's fences. Up
to a quarter of a group on either side doesn't move a fence; where over half of a group is junk the median is the junk's own.

The text is read once: signals are written to the shared folder and reread, and only those narrow rows are shuffled.
Sketch rows are bounded by groups x signals x buckets (about 4,000), whatever the number of documents.

Defined results for odd input: null text counts as a text without words (base rules fail it); very long texts are
counted whole, on one row; null lang and null source are groups of their own; a value on a fence is within it; repeated
rows are judged (and counted) each; words that repeat are told by 64-bit hashes of three-word windows, so counts are exact
but for collisions; an empty table gives an empty result; columns of the input other than the four named ones are not
read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.common import SPACE, written

SYMBOLS = r"[#*$%&|<>]"
OTHER = r"[^\p{L}\p{M}]"
ALPHA = 0.002
#: signal: the fences that it is held to.
SIGNALS = {"word_length": ("low", "high"), "other_share": ("high",), "line_words": ("low", "high"), "symbol_share": ("high",)}
#: Symbols are counted from here; the least spread of a signal in buckets, where it isn't 1.
SHIFT, LEAST = 10, {"symbol_share": 24}
#: Quantiles in percent.
LOW, MEDIAN, HIGH = 25, 50, 75
REACH, MIN_GROUP = 12, 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _count_of(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """id_col, g0.. (the group), n_words, word_chars, n_symbols, n_letters, n_lines, n_dup_lines, n_repeat_words."""
    picked = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)], F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    trimmed = F.btrim(F.col("t"), F.lit(" \t\n\x0b\f\r"))
    words = picked.withColumn("w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    lines = words.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = lines.select(
        "id", *[f"g{i}" for i in range(len(groups))], "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count_of(F.col("t"), SYMBOLS).alias("n_symbols"),
        F.length(F.regexp_replace("t", OTHER, "")).cast("long").alias("n_letters"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # windows of three words as 64-bit hashes; sorted with their places, equal ones are neighbours
    windows = counted.withColumn(
        "h",
        F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
        ),
    ).drop("w")
    placed = windows.withColumn(
        "s",
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
            F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ),
    ).drop("h")
    same = lambda e, k: F.coalesce(F.get("s", k)["h"] == e["h"], F.lit(False))
    again = placed.withColumn(
        "p", F.array_sort(F.transform(F.filter("s", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))
    ).drop("s")
    covered = F.aggregate(
        "p",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return again.withColumn("n_repeat_words", covered).drop("p").withColumnRenamed("id", id_col)


def with_signals(counts: DataFrame) -> DataFrame:
    per = lambda unit, a, b: F.when(b > 0, F.floor(unit * a / b)).otherwise(0).cast("long")
    words, chars = F.col("n_words"), F.col("word_chars")
    return counts.withColumns({
        "word_length": per(1000, chars, words), "other_share": per(100_000, chars - F.least(chars, F.col("n_letters")), chars),
        "line_words": per(1000, words, F.col("n_lines")), "symbol_share": F.when(words > 0, SHIFT + per(100, F.col("n_symbols"), words)).otherwise(0).cast("long"),
        "base_failed": (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words),
    })


def bucket_of(value: Column, alpha: float = ALPHA) -> Column:
    """0 for the value 0; k + 1 for values in (gamma^(k-1), gamma^k]."""
    log_gamma = math.log((1 + alpha) / (1 - alpha))
    return F.when(value <= 0, 0).otherwise(1 + F.ceil(F.log(value.cast("double")) / log_gamma)).cast("int")


def sketches(rows: DataFrame, groups: list[str], signals: list[str], alpha: float = ALPHA) -> DataFrame:
    """groups, signal, bucket, n. Sketches of parts of the corpus merge by adding n; so do those of groups."""
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in signals])
    long = rows.select(*groups, F.explode(pairs).alias("x")).select(*groups, "x.signal", "x.value")
    return long.groupBy(*groups, "signal", bucket_of(F.col("value"), alpha).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str], at: dict[str, int]) -> DataFrame:
    """groups, signal, total, and for each name in at (percent) the bucket of that quantile by nearest rank."""
    whole = Window.partitionBy(*groups, "signal")
    run = sketch.withColumns({
        "upto": F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(whole),
    })
    picks = [F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bucket"))).alias(name) for name, q in at.items()]
    return run.groupBy(*groups, "signal").agg(F.max("total").alias("total"), *picks)


def thresholds(rows: DataFrame, groups: list[str]) -> DataFrame:
    """One row for each group: groups and, as buckets, columns low_<signal> and high_<signal>."""
    at = {"low": LOW, "median": MEDIAN, "high": HIGH}
    sketch = sketches(rows, groups, list(SIGNALS))
    own = quantiles(sketch, groups, at)
    everywhere = quantiles(sketch.groupBy("signal", "bucket").agg(F.sum("n").alias("n")), [], at)
    everywhere = everywhere.select("signal", *[F.col(c).alias(f"all_{c}") for c in at])
    large = own.where(F.col("total") >= MIN_GROUP).groupBy("signal")
    middle = lambda d: F.floor(F.median(d))
    pooled = large.agg(middle(F.col("high") - F.col("median")).alias("up"), middle(F.col("median") - F.col("low")).alias("down"))
    both = own.join(everywhere, "signal").join(pooled, "signal", "left")
    small = F.col("total") < MIN_GROUP
    read = {c: F.when(small, F.col(f"all_{c}")).otherwise(F.col(c)) for c in at}
    least = F.lit(1)
    for s, buckets in LEAST.items():
        least = F.when(F.col("signal") == s, buckets).otherwise(least)
    high = read["median"] + REACH * F.greatest(read["high"] - read["median"], F.coalesce("up", F.lit(0)), least)
    low = read["median"] - REACH * F.greatest(read["median"] - read["low"], F.coalesce("down", F.lit(0)), least)
    fences = both.select(*groups, "signal", low.alias("low"), high.alias("high"))
    return fences.groupBy(*groups).agg(*[F.max(F.when(F.col("signal") == s, F.col(side))).alias(f"{side}_{s}") for s in SIGNALS for side in ("low", "high")])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The counts of `measured`, the signals, base_failed, the group's fences and kept, for each row of docs."""
    keys = [f"g{i}" for i in range(len(groups))]
    rows = with_signals(written(measured(docs, id_col, text_col, groups), "signals"))
    cuts = thresholds(rows.where("not base_failed"), keys).withColumnsRenamed({k: f"c_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"c_{k}"))
        on = same if on is None else on & same
    fits = F.lit(True)
    for s, sides in SIGNALS.items():
        for side in sides:
            fits = fits & ((bucket_of(F.col(s)) >= F.col(f"low_{s}")) if side == "low" else (bucket_of(F.col(s)) <= F.col(f"high_{s}")))
    return rows.join(cuts, on, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True)))
