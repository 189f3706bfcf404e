import math

from veritrail.llm.common import table
from veritrail.llm.quality_rules import ALPHA, HIGH, LEAST, LOW, MEDIAN, MIN_GROUP, REACH, SHIFT, SIGNALS, judged


def op5_quality_rules(spark, sf_dir):
    found = judged(table(spark, sf_dir, "documents"), "doc_id", "text", ("lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# The SQL keeps no sketch: it sorts each group's values, reads quantiles by exact rank, and turns those into buckets.
_BUCKET = f"CASE WHEN {{0}} <= 0 THEN 0 ELSE 1 + ceil(ln(({{0}})::DOUBLE) / {math.log((1 + ALPHA) / (1 - ALPHA))!r})::INT END"
_LEAST = f"CASE signal {' '.join(f"WHEN '{s}' THEN {n}" for s, n in LEAST.items())} ELSE 1 END"
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, {s} AS value FROM signals WHERE NOT base_failed" for s in SIGNALS)
_AT = lambda q: _BUCKET.format(f"min(CASE WHEN 100 * r >= {q} * n THEN value END)")
_FITS = " AND ".join(
    f"(SELECT bool_and({_BUCKET.format(f's.{s}')} {'>= c.low' if side == 'low' else '<= c.high'}) FROM fences c WHERE c.signal = '{s}' "
    "AND c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source) IS NOT FALSE"
    for s, sides in SIGNALS.items()
    for side in sides
)


def _ranked(keys):
    over = f"PARTITION BY {', '.join([*keys, 'signal'])}"
    lead = "".join(f"{k}, " for k in keys)
    return f"""SELECT {lead}signal, max(n) AS n, {_AT(LOW)} AS q_low, {_AT(MEDIAN)} AS q_median, {_AT(HIGH)} AS q_high
    FROM (SELECT *, row_number() OVER ({over} ORDER BY value) AS r, count(*) OVER ({over}) AS n FROM values_of) GROUP BY {lead}signal"""


ORACLE_SQL = {
    "op5_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS n FROM tri) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) AS o(k) GROUP BY r),
counts AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^\p{{L}}\p{{M}}]', '', 'g'))::BIGINT AS n_letters,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cover USING (r)),
signals AS (SELECT *, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length,
    CASE WHEN word_chars > 0 THEN 100000 * (word_chars - least(word_chars, n_letters)) // word_chars ELSE 0 END AS other_share,
    CASE WHEN n_lines > 0 THEN 1000 * n_words // n_lines ELSE 0 END AS line_words, CASE WHEN n_words > 0 THEN {SHIFT} + 100 * n_symbols // n_words ELSE 0 END AS symbol_share,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
values_of AS ({_LONG}),
own AS ({_ranked(['lang', 'source'])}),
everywhere AS ({_ranked([])}),
pooled AS (SELECT signal, floor(median(q_high - q_median)) AS up, floor(median(q_median - q_low)) AS down
    FROM own WHERE n >= {MIN_GROUP} GROUP BY signal),
read AS (SELECT o.lang, o.source, o.signal, CASE WHEN o.n < {MIN_GROUP} THEN e.q_low ELSE o.q_low END AS a,
    CASE WHEN o.n < {MIN_GROUP} THEN e.q_median ELSE o.q_median END AS m, CASE WHEN o.n < {MIN_GROUP} THEN e.q_high ELSE o.q_high END AS b,
    coalesce(p.up, 0) AS up, coalesce(p.down, 0) AS down FROM own o JOIN everywhere e USING (signal) LEFT JOIN pooled p USING (signal)),
fences AS (SELECT lang, source, signal, m - {REACH} * greatest(m - a, down, {_LEAST}) AS low, m + {REACH} * greatest(b - m, up, {_LEAST}) AS high FROM read)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_FITS} AS kept FROM signals s
"""
}
QUERIES = {"op5_quality_rules": op5_quality_rules}
