"""SimHash near-duplicate detection with pigeonring candidate filtering.

A 64-bit SimHash is taken of each document's word shingles. Fingerprints are linked if at most `max_bits` bits differ.
Candidates come from the pigeonring principle: cut a fingerprint into m segments on a ring; if the whole differs in at
most t bits, there is a segment from which every chain of l consecutive segments differs in at most l * t / m bits.
With m = t + 1 segments the first one must be equal, the first two may differ in one bit, and so on. A chain of consecutive
segments is the join's key: a fingerprint is indexed by the chain from each start, and probes with every value of it whose
cumulative differences keep to the budgets. So pairs that fail the chain test never meet, and the full Hamming distance
is taken of the others alone. The chain is made longer as fingerprints grow in number, so that chance meetings of
one stay under MEETINGS.

Exact copies share a fingerprint and are collapsed to one row before the join; a group of copies, however large,
therefore costs one row there. Linked fingerprints are merged to components by alternating large-star and small-star
rounds.

With `similarity` links are by text: two documents are linked if the Jaccard similarity of their shingle sets is at least
that. Fingerprints at most `max_bits` apart are candidates as before. But at 0.8 64-bit SimHashes differ in 10 bits on
average and up to 18, and at such a radius segments are too short to be keys; so candidates come from MinHash
bands of the same shingles too (20 of 5 rows: a pair at 0.8 shares one with probability 0.9996, closer ones with more). Each
link is then decided exactly, from the texts. A bucket of n texts doesn't make n^2 pairs: first each text is compared with
the bucket's least one and links are merged to components. In buckets of several components each text's shingles that no
other text of such buckets has are counted: they bound the similarity that it can have to any, or to one of a known size
and count, which leaves out texts that share no more than a passage or are changed too much. Then each text is compared
with the bucket's text that has the smallest part of own shingles, and last the pairs that are still in different
components and within bounds from 1024-bit maps of their shingles, which the join that makes them tests. What is skipped is
joined already or can't be similar, so components are those of all candidate pairs.

Defined results for odd input:
* null or empty text, or text of white space only: no words; fingerprint zero, linked like any other (by similarity: to
  each other);
* fewer words than a shingle: the whole word sequence is the only shingle;
* repeated shingles count each time in a fingerprint, once in a set; repeated rows stay rows, each with its own component;
* null ids: kept, with their fingerprint; a component's id is the smallest non-null id in it (null if it has none);
* very long texts: walked in blocks, whole;
* empty table: empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import apart, small_batches, written
from veritrail.llm.components import HOT, components, joined, named
from veritrail.llm.shingles import WORDS, bands, bitmaps, distinct, fetched, hashes, linked, own_shingles

BITS = 64
#: Unlinked fingerprints that one may meet by chance before the chain is made longer.
MEETINGS = 1000


def folded(parts: Iterable[np.ndarray]) -> int:
    """The unsigned fingerprint of hashes: a bit is 1 if it is set in over half of them."""
    total, set_bits = 0, np.zeros(BITS, np.int64)
    for part in parts:
        total += len(part)
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The SimHash of a UTF-8 text's word shingles."""
    return folded(hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row (id_col, fp long) for each row of docs."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["id", "fp"])

    id_type = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {id_type}, fp long").withColumnRenamed("id", id_col)


def ring(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths differ by one at most."""
    cuts = [BITS * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain_masks(widths: list[int], max_bits: int, segments: int) -> list[int]:
    """The differences of a chain of segments of these widths that keep every prefix's budget l * max_bits / segments."""
    masks, low = [(0, 0)], 0
    for length, width in enumerate(widths, 1):
        own = [(sum(1 << low + b for b in bits), d) for d in range(max_bits + 1) for bits in combinations(range(width), d) if d <= length * max_bits // segments]
        masks = [(m | o, n + d) for m, n in masks for o, d in own if n + d <= length * max_bits // segments]
        low += width
    return sorted(m for m, _ in masks)


def chain_length(n: int, max_bits: int, segments: int) -> int:
    """The least chain, from 2 segments on, by which a fingerprint of n meets at most MEETINGS others by chance."""
    parts = ring(segments)
    for length in range(min(2, segments), segments):
        widths = [w for _, w in parts[:length]]
        if n * segments * len(chain_masks(widths, max_bits, segments)) <= MEETINGS << sum(widths):
            return length
    return max(1, segments - 1)


def _turned(fp: Column, first: int, width: int) -> Column:
    """width bits of fp from bit first on, around the ring."""
    turned = fp if not first else F.shiftrightunsigned(fp, first).bitwiseOR(F.shiftleft(fp, BITS - first))
    return turned if width == BITS else turned.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _flipped(start: int, key: Column, masks: list[int]) -> Column:
    """An array of probes (start, key, same): the key under those masks whose lowest bit is 0 in it."""
    own = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: key.bitwiseAND(m).bitwiseAND(-m) == 0)
    return F.transform(own, lambda m: F.struct(F.lit(start).alias("start"), key.bitwiseXOR(m).alias("key"), (m == 0).alias("same")))


def candidates(distinct_fp: DataFrame, max_bits: int = 4, segments: int | None = None, chain: int | None = None) -> DataFrame:
    """Pairs (a, b) of different fingerprints that pass the chain test from some start; a pair may occur once a start.

    Of two fingerprints that differ within the key only that with a 0 at the lowest different bit probes, which halves
    the probes: 42 rows in all at the defaults, 37 of them probes. Shuffled rows grow in proportion to the fingerprints."""
    segments = segments or max_bits + 1
    chain = chain or chain_length(distinct_fp.count(), max_bits, segments)
    parts, fp = ring(segments), F.col("fp")
    index, probes = [], []
    for start in range(segments):
        widths = [parts[(start + k) % segments][1] for k in range(chain)]
        key = _turned(fp, parts[start][0], sum(widths))
        index.append(F.struct(F.lit(start).alias("start"), key.alias("key")))
        probes.append(_flipped(start, key, chain_masks(widths, max_bits, segments)))
    left = distinct_fp.select(fp.alias("a"), F.explode(F.array(*index)).alias("x")).select("a", "x.start", "x.key")
    right = distinct_fp.select(fp.alias("b"), F.explode(F.concat(*probes)).alias("x")).select("b", "x.start", "x.key", "x.same")
    met = left.join(apart(right), ["start", "key"]).where(~F.col("same") | (F.col("a") < F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(distinct_fp: DataFrame, max_bits: int = 4, segments: int | None = None, chain: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints at most max_bits apart; distinct_fp has one column, fp."""
    met = candidates(distinct_fp, max_bits, segments, chain)
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()


def _by_text(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, cls: XXH64 of the text, fp, bands, size: of its shingle set) for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("cls"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, sizes = [], [], []
            for text in batch.column(2):
                parts = list(hashes(text.as_py(), shingle))
                fps.append(folded(parts))
                keys.append(bands(distinct(parts)))
                sizes.append(len(distinct(parts)))
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "cls", "fp", "bands", "size"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, cls long, fp long, bands array<long>, size long")


def _similar_links(docs: DataFrame, text_col: str, classes: DataFrame, max_bits: int, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) between classes (cls, fp, bands, size) of docs that have the components of all similar candidates."""
    over, under = similarity
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("cls"), text.cast("binary").alias("text"))
    fp_key = F.xxhash64(F.lit("fp"), "fp")
    index = classes.select("cls", "size", F.explode(F.concat("bands", F.array(fp_key))).alias("band"))
    near = written(links(classes.select("fp").distinct(), max_bits), "near")
    ends = near.select(F.xxhash64("a", "b").alias("band"), F.explode(F.array("a", "b")).alias("fp"))
    index = index.unionByName(ends.join(apart(classes.select("cls", "fp", "size")), "fp").select("cls", "size", "band"))
    buckets = index.groupBy("band").agg(F.min("cls").alias("lead"), F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets, "leads")
    most = buckets.agg(F.max("n")).first()[0] or 0
    shared = written(joined(index, buckets.drop("n"), "band", "cls", most), "buckets")
    texts = fetched(texts, written(shared.select("cls").distinct(), "needed"))
    first = written(shared.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct(), "pairs")
    found = written(linked(texts, first, shingle, similarity), "similar")
    # shingles that a text has alone, of those whose bucket is not of one component, tell what it can be similar to
    open_ = written(_mixed(shared.drop("lead"), components(found), most), "open")
    own = written(own_shingles(texts.join(open_.select("cls").distinct(), "cls", "left_semi"), shingle), "own")
    open_ = open_.join(apart(own), "cls", "left").withColumn("rest", F.col("size") - F.coalesce("own", F.lit(0)))
    open_ = written(open_.where(under * F.col("rest") >= over * F.col("size")).drop("own", "root", "most"), "open")
    central = open_.groupBy("band").agg(F.max_by("cls", F.struct(F.col("rest") / F.col("size"), "cls")).alias("lead"))
    second = joined(open_, central, "band", "cls", most).where("cls <> lead").select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b"))
    second = written(second.distinct().join(apart(first), ["a", "b"], "left_anti"), "pairs")
    found = written(found.unionByName(linked(texts, second, shingle, similarity)), "similar")
    # a pair in different components has at least one end outside the bucket's largest
    open_ = written(_mixed(open_, components(found), most), "open")
    bits = written(bitmaps(texts.join(open_.select("cls").distinct(), "cls", "left_semi"), shingle), "bits")
    outside, inside = _dealt(open_, bits, 1.01 * under / over)
    side = lambda rows, n: rows.select("band", "part", "sized", *[F.col(c).alias(f"{c}_{n}") for c in ("cls", "root", "size", "rest", "bits")])
    lacks = lambda a, b: sum(F.bit_count(F.get(f"bits_{a}", k).bitwiseAND(F.bitwise_not(F.get(f"bits_{b}", k)))) for k in range(WORDS))
    common = F.least("rest_x", "rest_y", F.col("size_x") - lacks("x", "y"), F.col("size_y") - lacks("y", "x"))  # at most
    fits = under * common >= over * (F.col("size_x") + F.col("size_y") - common)
    third = side(outside, "x").join(apart(side(inside, "y")), ["band", "part", "sized"]).where((F.col("root_x") != F.col("root_y")) & fits)
    third = third.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b")).distinct()
    third = written(third.join(apart(first), ["a", "b"], "left_anti").join(apart(second), ["a", "b"], "left_anti"), "pairs")
    return found.unionByName(written(linked(texts, third, shingle, similarity), "similar"))


def _dealt(open_: DataFrame, bits: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """open_ (band, cls, root, most, size, ...) with bits (cls, bits) as the two sides of a join on band, part and sized: the rows outside their bucket's
    largest component, and all rows. Sizes of similar sets differ by less than the ratio, so a row of one size class meets that
    class and its neighbours alone; and the rows outside of a large bucket are dealt in parts of about HOT, each of which meets all others."""
    sized = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.log(F.lit(ratio)))
    parts = open_.where("root <> most").groupBy("band").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
    most = open_.groupBy("band").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rows = written(joined(open_.join(apart(bits), "cls"), written(parts, "parts"), "band", "cls", most), "dealt")
    outside = rows.where("root <> most").withColumn("sized", sized).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    inside = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return outside, inside.withColumn("sized", F.explode(F.array(sized - 1, sized, sized + 1)))


def _mixed(shared: DataFrame, root: DataFrame, most: int) -> DataFrame:
    """Of shared (band, cls, ...) the rows of buckets with more than one component, with root, and the largest as most."""
    placed = shared.join(apart(root), shared["cls"] == root["node"], "left").drop("node").withColumn("root", F.coalesce("root", "cls"))
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    return joined(placed, mixed.drop("kinds"), "band", "cls", most)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, similarity: tuple[int, int] | None = None,
) -> DataFrame:
    """(id_col, fp, component_id) for each row of docs; component_id is the smallest id reachable over links.

    similarity: a fraction (over, under); None links by fingerprints alone. Ids may be of any type that has an order."""
    small_batches(docs.sparkSession)
    if similarity is None:
        marked, key = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints"), "fp"
        rows = marked.select(F.col(id_col).alias("id"), "fp")
        classes = written(rows.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n")), "classes")
        found = links(classes.select("fp"), max_bits)
    else:
        rows, key = written(_by_text(docs, id_col, text_col, shingle), "signatures"), "cls"
        made = rows.groupBy("cls").agg(F.min("id").alias("least_id"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size"))
        classes = written(made, "classes")
        found = _similar_links(docs, text_col, classes, max_bits, shingle, similarity)
        rows = rows.drop("bands", "size")
    by_class = named(classes.select(key, "least_id"), found, key, "least_id")
    most = classes.agg(F.max("n")).first()[0] or 0
    return joined(rows, by_class, key, "id", most).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
