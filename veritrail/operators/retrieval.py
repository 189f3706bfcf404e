"""Composite retrieval: cross-corpus search, chat modes and evidence tools, as plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import text as T
from veritrail.operators.graph import saved
from veritrail.operators.index import PostingsIndex
from veritrail.operators.relational import diversified, fused
from veritrail.operators.search import bm25

#: Weights of the corpora.
CORPUS_WEIGHTS = {"internal_reports": 1.15, "scientific_journals": 1.00, "conference_materials": 1.05, "reviews": 1.10, "scientific_articles": 1.05}
QUERY = "therefore shesh eauon tionou license"
#: The least match of a facet, of a problem, of a constraint.
FACET, PROBLEM, CONSTRAINT = 0.45, 0.30, 0.80


def corpus_weight(corpus: Column, weights: dict[str, float] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in (weights or CORPUS_WEIGHTS).items() for x in pair])
    return F.coalesce(F.try_element_at(table, corpus), F.lit(1.0))


def channel_lists(scored: DataFrame, channel: str, window: int) -> DataFrame:
    """The best `window` rows of each corpus, unreadable texts dropped."""
    n = F.row_number().over(Window.partitionBy("corpus_id").orderBy(F.desc("score"), "chunk_id"))
    best = scored.withColumn("_n", n).where(F.col("_n") <= window).drop("_n")
    return best.where(T.is_readable(F.col("text"))).withColumns({"channel": F.lit(channel), "text": T.clean_retrieval(F.col("text"))})


def cross_corpus_search(
    chunks: DataFrame, query: str = QUERY, slots: Sequence[str] = ("license terms", "shesh"), final_k: int = 20, k_per_corpus: int = 10, id_col: str = "doc_id",
    document_col: str = "doc_id", corpus_col: str = "source", text_col: str = "text", dense: DataFrame | None = None, strict_numbers: bool = False,
    weights: dict[str, float] | None = None, rerank: DataFrame | None = None, index: PostingsIndex | None = None,
) -> DataFrame:
    """rank, chunk_id, document_id, corpus_id, score, rrf_norm, bm25_norm, dense_norm, matched_slots.

    BM25 (and, given `dense` as (chunk_id, score), dense) lists of each corpus are fused, scored with slots and numbers,
    weighed by corpus, sorted, and capped by document and corpus. rerank: (chunk_id, rerank) scores of a model, if there is
    one; a chunk that has none keeps its score by rank. index: a written index of chunks by corpus, which takes the place of the scan;
    texts are then read for the chunks that it finds alone."""
    window = max(50, 3 * k_per_corpus)
    named = chunks.select(F.col(id_col).alias("chunk_id"), F.col(document_col).alias("document_id"), F.col(corpus_col).alias("corpus_id"), F.col(text_col).alias("text"))
    terms = T_terms(query)
    if index is None:
        scored = bm25(named, terms, "chunk_id", "text", keep=["document_id", "corpus_id", "text"])
    else:  # at most `window` rows of each corpus, written, so that their size is known
        scored = named.join(saved(index.search(terms, window, by_group=True).found.select(F.col("id").alias("chunk_id"), "score")), "chunk_id")
    lists = channel_lists(scored, "bm25", window)
    if dense is not None:
        lists = lists.unionByName(channel_lists(named.join(dense, "chunk_id"), "dense", window).select(*lists.columns))
    candidates = fused(lists, max(40, 4 * final_k))
    wanted = numbers_in(query)
    numeric = T.numeric_score(F.array(*wanted), T.numeric_mentions(F.col("text"))) if wanted else F.lit(0.0)
    scored = candidates.withColumns({"matched_slots": T.matched_slots(list(slots), F.col("text")), "numeric": numeric})
    if strict_numbers and wanted:
        scored = scored.where("numeric > 0")
    final = T.final_score(F.col("rrf_norm"), F.col("dense_norm"), F.col("bm25_norm"), F.col("matched_slots"), len(slots), F.col("numeric"), corpus_weight(F.col("corpus_id"), weights))
    scored = scored.withColumn("score", final)
    if rerank is not None:
        one = T.reranked_score(F.col("rerank"), F.col("dense_norm"), F.col("bm25_norm"), F.col("matched_slots"), len(slots), F.lit(0.8), F.col("numeric"), corpus_weight(F.col("corpus_id"), weights))
        scored = scored.join(rerank, "chunk_id", "left").withColumn("score", F.coalesce(one, "score"))
    best = diversified(scored, final_k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # at most final_k rows
    return best.select(rank.alias("rank"), "chunk_id", "document_id", "corpus_id", "score", F.round("rrf_norm", 6).alias("rrf_norm"), F.round("bm25_norm", 6).alias("bm25_norm"),
                       F.round("dense_norm", 6).alias("dense_norm"), "matched_slots")


def T_terms(query: str) -> list[str]:
    import re

    return re.findall(r"[\w-]{2,}", query.lower())[:24]


def numbers_in(query: str) -> list[Column]:
    import re

    found = re.findall(rf"(\d+(?:[.,]\d+)?)\s*({T.NUMERIC_UNITS})?", query, flags=re.I)[:20]
    return [F.struct(F.lit(float(v.replace(",", "."))).alias("value"), F.lit(u or None).cast("string").alias("unit")) for v, u in found]


def by_document(hits: DataFrame, chunks: DataFrame, separator: str = "\n----\n") -> DataFrame:
    """document_id, score (mean of its hits), text (its hits' texts, best first), n: the context of vector and full-text modes."""
    joined = hits.join(chunks, "chunk_id")
    made = joined.groupBy("document_id").agg(F.avg("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", "text"))).alias("c"))
    return made.select("document_id", "score", F.array_join(F.transform("c", lambda c: c["text"]), separator).alias("text"), F.size("c").alias("n"))


def source_evidence(elements: DataFrame, tokens: Sequence[str], facts: DataFrame | None = None, limit: int = 24) -> DataFrame:
    """document_id, element_id, matched, fact_count, confidence: a lexical scan of source elements (document_id, element_id,
    text); facts: (element_id, fact)."""
    matched = F.filter(T.texts(list(tokens)), lambda k: F.contains(F.lower("text"), k))
    hits = elements.withColumn("matched", matched).where(F.size("matched") >= (1 if len(tokens) <= 2 else 2))
    if facts is not None:
        counts = facts.groupBy("element_id").agg(F.count_distinct("fact").alias("fact_count"))
        hits = hits.join(counts, "element_id", "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0)))
    else:
        hits = hits.withColumn("fact_count", F.lit(0).cast("long"))
    best = hits.orderBy(F.desc(F.size("matched")), F.desc("fact_count"), "element_id").limit(max(1, min(100, limit))).where(T.is_readable(F.col("text")))
    confidence = F.least(F.lit(1.0), 0.45 + 0.4 * F.size("matched") / len(tokens))
    return best.select("document_id", "element_id", "matched", "fact_count", F.round(confidence, 6).alias("confidence"))


def synthetic_gap(spark, **filters) -> DataFrame:
    """The one row that a tool returns if nothing matches."""
    told = ", ".join(f"{k}={v}" for k, v in sorted(filters.items()) if v not in (None, "", [], ()))
    row = [("missing_evidence", "No verified evidence matches the requested combination", told, "high", "tool_query")]
    return spark.createDataFrame(row, "type string, description string, filters string, severity string, detected_by string")


def found_or_gap(found: DataFrame, **filters) -> DataFrame:
    """The gap that a tool reports instead of results: one row if found is empty, none otherwise. Of found at most one row is looked at."""
    return synthetic_gap(found.sparkSession, **filters).join(found.limit(1).select(F.lit(1).alias("_one")), F.lit(True), "left_anti")


def pathways(experiments: DataFrame, branches: dict[str, DataFrame], limit: int, include_incomplete: bool = True) -> DataFrame:
    """Role chains of experiments: one row for each combination of a material, process, equipment and result.

    experiments: id, confidence, status. branches: role -> (experiment, id, confidence, status). Keys are combined, ranked
    by (confidence of the experiment DESC, ids) and cut before anything else is attached. missing: the roles without a
    node; confidence: the least on the path (0.5 if none); status: conflicting, low_confidence (under 0.65) or verified."""
    roles = ["material", "process", "equipment", "result"]
    rows = experiments.select(F.col("id").alias("experiment"), F.col("confidence").alias("experiment_confidence"), F.col("status").alias("experiment_status"))
    for role in roles:
        own = branches[role].groupBy("experiment").agg(F.array_sort(F.collect_set(F.struct("id", "confidence", "status"))).alias(f"_{role}"))
        rows = rows.join(own, "experiment", "left")
    if not include_incomplete:
        for role in roles:
            rows = rows.where(F.col(f"_{role}").isNotNull())
    first = rows.orderBy(F.desc(F.coalesce("experiment_confidence", F.lit(0.0))), "experiment").limit(min(500, max(limit * 4, limit)))
    for role in roles:
        first = first.withColumn(role, F.explode_outer(f"_{role}")).drop(f"_{role}")
    order = [F.desc(F.coalesce("experiment_confidence", F.lit(0.0))), F.col("experiment"), *[F.asc_nulls_first(f"{r}.id") for r in roles]]
    cut = first.orderBy(*order).limit(limit)
    values = [F.col("experiment_confidence"), *[F.col(f"{r}.confidence") for r in roles]]
    confidence = F.coalesce(F.array_min(F.array(*values)), F.lit(0.5))
    statuses = F.array(F.col("experiment_status"), *[F.col(f"{r}.status") for r in roles])
    status = F.when(F.array_contains(F.array_compact(statuses), "conflicting"), "conflicting").when(confidence < 0.65, "low_confidence").otherwise("verified")
    missing = F.array_compact(F.array(*[F.when(F.col(f"{r}.id").isNull(), F.lit(r)) for r in roles]))
    return cut.select("experiment", *[F.col(f"{r}.id").alias(r) for r in roles], missing.alias("missing"), (F.size(missing) == 0).alias("complete"), F.round(confidence, 3).alias("confidence"), status.alias("status"))


def facts_found(facts: DataFrame, answers: DataFrame, id_col: str, fact_col: str, answer_col: str) -> DataFrame:
    """(id_col, found): how many answers each fact is found in, by `text.fact_matches`. Each text is cut into its keys once; facts and answers
    meet on equal keys, so no pair without a common word is made."""
    told = facts.select(id_col, F.monotonically_increasing_id().alias("_f"), T.fact_keys(F.col(fact_col)).alias("_keys"))
    asked = told.select("_f", F.size("_keys").alias("_words"), F.explode("_keys").alias("_key")).groupBy("_f", "_words", "_key").agg(F.count("*").alias("_times"))
    numbered = answers.select(F.monotonically_increasing_id().alias("_a"), T.answer_keys(F.col(answer_col)).alias("_keys"))
    held = numbered.select("_a", F.explode("_keys").alias("_key"))
    met = held.join(asked, "_key").groupBy("_f", "_a", "_words").agg(F.sum("_times").alias("_n")).where("10 * _n >= 7 * _words")
    counts = met.groupBy("_f").agg(F.count("*").alias("_n"))
    return told.join(counts, "_f", "left").groupBy(id_col).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("found"))


def conditions_match(conditions: DataFrame, wanted: DataFrame) -> DataFrame:
    """ids whose conditions meet every wanted range: conditions (id, parameter, low, high, unit), wanted (parameter, min, max,
    unit; nulls don't restrict). Ranges must overlap; all wanted parameters must be met."""
    w = wanted.select(F.col("parameter").alias("_p"), F.col("min").alias("_min"), F.col("max").alias("_max"), F.col("unit").alias("_u"))
    n = wanted.count()
    met = conditions.join(F.broadcast(w), F.col("parameter") == F.col("_p")).where(  # wanted: the few ranges of a request
        (F.col("_u").isNull() | (F.col("unit") == F.col("_u"))) & (F.col("_min").isNull() | (F.col("high") >= F.col("_min"))) & (F.col("_max").isNull() | (F.col("low") <= F.col("_max")))
    )
    return met.groupBy("id").agg(F.count_distinct("_p").alias("n")).where(F.col("n") == n).select("id")


def find_experiments(experiments: DataFrame, facets: Sequence[DataFrame], meeting: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """id, match, confidence of experiments (id, confidence) that every facet (id, score) matches at FACET or more and that
    `meeting` (id), if given, names. match: the mean of the facets' best scores (1 without facets). Best first, ties to the
    smaller id."""
    found = experiments.select("id", "confidence")
    for k, facet in enumerate(facets):
        found = found.join(facet.groupBy("id").agg(F.max("score").alias(f"_f{k}")).where(F.col(f"_f{k}") >= FACET), "id")
    if meeting is not None:
        found = found.join(meeting.select("id"), "id", "left_semi")
    match = sum((F.col(f"_f{k}") for k in range(len(facets))), F.lit(0.0)) / len(facets) if facets else F.lit(1.0)
    return found.select("id", match.alias("match"), "confidence").orderBy(F.desc("match"), F.desc("confidence"), "id").limit(limit)


def find_technologies(claims: DataFrame, limit: int = 30) -> DataFrame:
    """id, score, constraint_status of claims (id, problem, constraint, context: matches from 0 to 1, null as 0) whose problem
    matches, or whose constraint matches in a matching context. Best first, ties to the smaller id."""
    p, c, x = (F.coalesce(F.col(n), F.lit(0.0)) for n in ("problem", "constraint", "context"))
    score = F.round(F.least(F.lit(1.0), p + 0.15 * c + 0.05 * x), 6)
    kept = claims.where((p >= PROBLEM) | ((c >= CONSTRAINT) & (x >= PROBLEM)))
    return kept.select("id", score.alias("score"), F.when(c > 0, "met").otherwise("unknown").alias("constraint_status")).orderBy(F.desc("score"), "id").limit(limit)


def find_findings(findings: DataFrame, said: dict[str, str], order: str, limit: int = 50) -> DataFrame:
    """Contradictions or gaps whose columns hold the given substrings, without regard to case; `order` sorts as a string, last first."""
    for column, part in said.items():
        findings = findings.where(F.contains(F.lower(column), F.lit(part.lower())))
    return findings.orderBy(F.desc(order)).limit(limit)


def find_experts(works: DataFrame, least_works: int = 1) -> DataFrame:
    """expert, score from works (expert, work, topic, process: matches, null if not asked): an expert's distinct works whose
    weaker match is FACET or more give 0.2 and 0.1 each, 1 at most."""
    n = works.where(F.least("topic", "process") >= FACET).groupBy("expert").agg(F.count_distinct("work").alias("n"))
    return n.where(F.col("n") >= least_works).select("expert", F.least(F.lit(1.0), 0.2 + 0.1 * F.col("n")).alias("score"))


def map_reduced(reports: DataFrame, points: Column, per_community: int = 3, total: int = 20) -> DataFrame:
    """community, point, score: each report (community, ...) maps to points (an array of (point, score)); those over 0 are
    cut to each community's best, then reduced to the best of all."""
    from veritrail.operators.relational import capped

    made = reports.select("community", F.inline(points)).where("score > 0")
    return capped(made, "community", [F.desc("score"), F.col("point")], per_community).orderBy(F.desc("score"), "point").limit(total)
