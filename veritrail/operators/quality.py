"""Graph quality and analytics: metrics, coverage, shapes, derived nodes and views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions.text import OPPOSITES, has_any, opposed
from veritrail.operators.graph import both_ways, saved

#: Experiments of up to so many entities take their lists along.
LISTED = 64
#: Combinations that are looked for in all claims, by name and terms.
GAP_PATTERNS = (
    ("закачка шахтных вод", ("закач", "injection")), ("скорость циркуляции католита", ("католит", "catholyte")),
    ("кучное выщелачивание в холодном климате", ("кучн", "heap leaching")), ("обессоливание шахтных вод", ("обессол", "desalination")),
)


def metrics(parts: dict[str, tuple[DataFrame, DataFrame | None]], must_be_zero: Sequence[str]) -> DataFrame:
    """One row: for each name the rows of its first table, without those whose id the second holds; and passed."""
    out = None
    for name, (rows, without) in parts.items():
        counted = rows if without is None else rows.join(without.select("id").distinct(), "id", "left_anti")
        one = counted.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # single rows
    passed = F.lit(True)
    for name in must_be_zero:
        passed = passed & (F.col(name) == 0)
    return out.withColumn("passed", passed)


def document_coverage(documents: DataFrame, elements: DataFrame, facts: DataFrame) -> DataFrame:
    """document, category, elements, facts: distinct source elements, and distinct facts that they are evidence of."""
    n = elements.groupBy("document").agg(F.count_distinct("element").alias("elements"))
    m = elements.join(facts, "element").groupBy("document").agg(F.count_distinct("fact").alias("facts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return documents.join(n, "document", "left").join(m, "document", "left").select("document", "category", zero("elements"), zero("facts"))


def top_degrees(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """kind, id, degree, rank: the k nodes of each kind with most edges."""
    degree = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("degree"), "id"))
    return nodes.join(degree, "id").withColumn("rank", rank).where(F.col("rank") <= k).select("kind", "id", "degree", "rank")


@dataclass(frozen=True)
class Shape:
    """What each node of a label must have: properties, one of several properties, relations, and values from a list."""

    label: str
    properties: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    relations: tuple[str, ...] = ()
    allowed: tuple[tuple[str, tuple[str, ...]], ...] = ()


SHAPES = (
    Shape("Measurement", ("id", "validation_status"), ("numeric_value", "value_min", "value_max"), ("MEASURES_PROPERTY", "HAS_UNIT", "EVIDENCED_BY")),
    Shape("Condition", ("id", "comparator", "validation_status"), (), ("HAS_PARAMETER", "EVIDENCED_BY"), (("comparator", ("=", "<", "<=", ">", ">=", "range")),)),
    Shape("Claim", ("id", "source_text", "validation_status"), (), ("SUPPORTED_BY",)),
    Shape("RelationshipAssertion", ("id", "validation_status"), (), ("EVIDENCED_BY",)),
)


def violations(nodes: DataFrame, edges: DataFrame, shapes: Sequence[Shape] = SHAPES) -> DataFrame:
    """id, label, path: a row for each constraint that a node breaks."""
    out = nodes.select("id", "label", F.lit(None).cast("string").alias("path")).limit(0)
    for shape in shapes:
        own = nodes.where(F.col("label") == shape.label)
        tests = [(p, F.col(p).isNull()) for p in shape.properties]
        if shape.any_of:
            tests.append(("value", F.coalesce(*[F.col(p).isNotNull().cast("int") * F.lit(1) if len(shape.any_of) == 1 else F.when(F.col(p).isNotNull(), 1) for p in shape.any_of], F.lit(0)) == 0))
        tests += [(p, F.col(p).isNotNull() & ~F.col(p).isin(*values)) for p, values in shape.allowed]
        if tests:
            broken = F.array_compact(F.array(*[F.when(test, F.lit(path)) for path, test in tests]))
            out = out.union(own.select("id", "label", F.explode(broken)))
        for rel in shape.relations:
            has = edges.where(F.col("rel") == rel).select(F.col("src").alias("id"))
            out = out.union(own.select("id", "label").join(has, "id", "left_anti").select("id", "label", F.lit(rel)))
    return out


def contradictions(claims: DataFrame, groups=OPPOSITES) -> DataFrame:
    """(a, b): pairs of claims (id, topic, text) of one topic that oppose each other. Only claims with a term of some group
    meet, each side with its opposite, so a topic's other claims aren't paired."""
    out = None
    for first, second in groups:
        text = F.lower("text")
        left = claims.where(has_any(text, first)).select(F.col("id").alias("x"), "topic", F.col("text").alias("tx"))
        right = claims.where(has_any(text, second)).select(F.col("id").alias("y"), "topic", F.col("text").alias("ty"))
        pairs = left.join(right, "topic").where("x <> y").where(opposed(F.col("tx"), F.col("ty"), ((first, second),)))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        out = pairs if out is None else out.union(pairs)
    return out.distinct()


def consensus(claims: DataFrame, least: int = 2) -> DataFrame:
    return claims.groupBy("topic").agg(F.count_distinct("id").alias("claims")).where(F.col("claims") >= least)


def similar_cases(uses: DataFrame) -> DataFrame:
    """(a, b, shared, score): experiments (id) that share an entity (shared).

    Experiments of up to LISTED entities take their lists along to each, so that two of them find all that they share where they meet on the first
    of it, and pairs aren't grouped. Pairs with a longer one are grouped."""
    sets = saved(uses.where("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("shared")).alias("own")))
    at = lambda rows: rows.select("id", "own", F.explode("own").alias("met"))
    short, every = at(sets.where(F.size("own") <= LISTED)), at(sets).drop("own")
    side = lambda name: short.select(F.col("id").alias(name), F.col("own").alias(f"{name}_own"), "met")
    both = F.array_intersect("a_own", "b_own")  # in order, as the lists are
    found = side("a").join(side("b"), "met").where((F.col("a") < F.col("b")) & (F.get(both, 0) == F.col("met"))).select("a", "b", both.alias("shared"))
    long = at(sets.where(F.size("own") > LISTED)).select(F.col("id").alias("long"), "met")
    pairs = long.join(every, "met").where("long <> id").select(F.least("long", "id").alias("a"), F.greatest("long", "id").alias("b"), "met")
    rest = pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set("met")).alias("shared"))
    return found.unionByName(rest).withColumn("score", F.lit(0.7))


def opposers(claims: DataFrame, id_col: str, topic_col: str, text_col: str, groups: Sequence) -> DataFrame:
    """claims (one row each) with `opposers`: how many others of the same topic they oppose, where that is one or more.

    Whom a claim opposes depends on which sides of the groups it takes, so claims are counted by topic and sides, and those
    few classes are compared, not the claims."""
    small = F.lower(F.col(text_col))
    sides = F.array(*[has_any(small, terms) for group in groups for terms in group])
    marked = claims.withColumn("_sides", sides).where(F.exists("_sides", lambda x: x))
    classes = marked.groupBy(F.col(topic_col).alias("_topic"), "_sides").agg(F.count("*").alias("_n"))
    own, other = classes.select("_topic", "_sides"), classes.select(F.col("_topic").alias("_t"), F.col("_sides").alias("_s"), "_n")
    against = F.lit(False)
    for k in range(0, 2 * len(groups), 2):
        for x, y in ((k, k + 1), (k + 1, k)):
            against = against | (F.get("_sides", x) & F.get("_s", y))
    met = own.join(other, (F.col("_topic") == F.col("_t")) & against)
    counts = met.groupBy("_topic", "_sides").agg(F.sum(F.col("_n") - (F.col("_sides") == F.col("_s")).cast("long")).alias("opposers"))
    joined = marked.withColumnRenamed(topic_col, "_topic").join(counts, ["_topic", "_sides"]).where("opposers > 0")
    return joined.withColumnRenamed("_topic", topic_col).drop("_sides")


def risks(claims: DataFrame) -> DataFrame:
    """A risk for each limitation of a claim (id, limitations)."""
    return claims.select("id", F.explode("limitations").alias("description")).withColumn("severity", F.lit("unknown"))


def applicability(technology_claims: DataFrame) -> DataFrame:
    return technology_claims.select("technology", "claim", "geo_scope", F.lit("evidence_available").alias("status"))


def knowledge_gaps(claims: DataFrame, patterns=GAP_PATTERNS) -> DataFrame:
    """gap, severity: patterns none of whose terms any claim contains."""
    text = F.lower("text")
    seen = claims.agg(*[F.coalesce(F.bool_or(has_any(text, terms)), F.lit(False)).alias(f"p{k}") for k, (_, terms) in enumerate(patterns)])
    gaps = F.array_compact(F.array(*[F.when(~F.col(f"p{k}"), F.lit(name)) for k, (name, _) in enumerate(patterns)]))
    return seen.select(F.explode(gaps).alias("gap"), F.lit("high").alias("severity"))


def community_summaries(members: DataFrame, top: int) -> DataFrame:
    """community, size, summary: the members of the greatest weight, named (a deterministic stand-in for a model's text)."""
    own = Window.partitionBy("community")
    n = F.row_number().over(own.orderBy(F.desc("weight"), "name"))
    ranked = members.withColumn("size", F.count("*").over(own)).withColumn("n", n).where(F.col("n") <= top)
    named = ranked.groupBy("community").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "name"))).alias("m"))
    return named.select("community", "size", F.array_join(F.transform("m", lambda m: m["name"]), ", ").alias("summary"))


def document_view(chunk_doc: DataFrame, chunk_entity: DataFrame, documents: Sequence, most: int = 50) -> DataFrame:
    """src, rel, dst of the view of some documents: at most `most` chunks each, their order, and the entities they mention."""
    w = Window.partitionBy("doc").orderBy("chunk")
    chunks = chunk_doc.where(F.col("doc").isin(list(documents))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    k = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    part = chunks.select(k("c", "doc").alias("src"), F.lit("PLACED").alias("rel"), k("o", "chunk").alias("dst"))
    nxt = chunks.withColumn("next", F.lead("chunk").over(w)).where("next is not null").select(k("o", "chunk"), F.lit("NEXT_CHUNK"), k("o", "next"))
    entities = chunk_entity.join(chunks.select("chunk"), "chunk", "left_semi").select(k("o", "chunk"), F.lit("USES_MATERIAL"), k("p", "entity"))
    return part.union(nxt).union(entities).distinct()


def source_tree(elements: DataFrame) -> DataFrame:
    """src, rel, dst from (document, page, part): pages once, each chunk under its page."""
    doc = F.col("document").cast("string")
    page = F.concat_ws("/", doc, F.col("page").cast("string"))
    pages = elements.select(doc.alias("src"), F.lit("HAS_PAGE").alias("rel"), page.alias("dst"))
    return pages.union(elements.select(page, F.lit("HAS_CHUNK"), F.concat_ws("/", page, F.col("part").cast("string")))).distinct()
