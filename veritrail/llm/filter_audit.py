"""Audit of how filters interact: what each removes, alone and behind the others, in every order of application.

Each document becomes a mask with a bit for each filter that it fails. Masks are counted by part (and label) before
anything else, so what is expanded by the 120 orders and 5 steps is at most 32 masks for each part and label, whatever the
number of documents.

The filter of duplicates refines a partition: documents are split by length in code points, then by the hash of one block
of their text after the other (blocks grow eightfold); after each split documents alone in their class are dropped. The
whole texts of the survivors are compared (they are the keys of a grouping), and all but the smallest id of each text fail. Rounds pass narrow rows only, the texts
of survivors are shuffled once, merged by each task before, and hot classes are dealt in parts.

Filters: A under 200 words; B under half of the words distinct; C over 3 % of code points in A-Z; D a symbol of #$%&*|;
E the text of a document with a smaller id.

Defined results for odd input: null text counts as empty (which fails A, and E behind a smaller id); a null id is no
smaller than any other and never fails E; equal ids with equal texts don't make each other fail; repeated rows count each;
a null language is the part "", as is an empty one; several labels of one id count as good or toxic if any of them says so, null labels
as neither; very long texts are hashed block by block, whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.bloom import suspected
from veritrail.llm.common import small_batches, written
from veritrail.llm.components import joined

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3
DUPLICATE = 1 << FILTERS.index("E")
#: Bytes of the first block; each one after it has GROWTH times as many.
BLOCK, GROWTH = 64, 8
#: Bytes of a text that are split into words at once.
_PART = 1 << 20
_SYMBOL = regex.compile(rb"[#$%&*|]")
_SPACE = regex.compile(rb"[\x20\x09-\x0D]")
_UPPER = bytes(range(65, 91))
_FOLLOWS = bytes(range(0x80, 0xC0))


def block_hashes(data: bytes) -> list[int]:
    """XXH64 of each block of a text, as signed numbers."""
    out, at, size, view = [], 0, BLOCK, memoryview(data)
    while at < len(data):
        value = xxhash.xxh64_intdigest(view[at : at + size], len(out))
        out.append(value - (value >> 63 << 64))
        at, size = at + size, size * GROWTH
    return out


def word_counts(data: bytes) -> tuple[int, int]:
    """(words, distinct words); a long text is split part by part, before white space."""
    n, seen, at = 0, set(), 0
    while at < len(data):
        end = _SPACE.search(data, at + _PART) if len(data) - at > _PART else None
        stop = end.start() if end else len(data)
        words = data[at:stop].split()
        n += len(words)
        seen.update(words)
        at = stop
    return n, len(seen)


def judged(data: bytes) -> tuple[int, int]:
    """(mask of the filters A to D, code points)."""
    n, distinct = word_counts(data)
    chars = len(data.translate(None, _FOLLOWS))
    upper = len(data) - len(data.translate(None, _UPPER))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * upper > MAX_UPPER * chars, bool(_SYMBOL.search(data))]
    return sum(f << k for k, f in enumerate(fails)), chars


def signed(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask, chars, blocks array<long>, digest: SHA-256 of the text) for each row; the only pass over all texts."""
    small_batches(docs.sparkSession)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).alias("id"), part.alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, sizes, blocks, digests = [], [], [], []
            for text in batch.column(2):
                mask, chars = judged(data := text.as_py())
                masks.append(mask)
                sizes.append(chars)
                blocks.append(block_hashes(data))
                digests.append(hashlib.sha256(data).digest())
            made = [pa.array(masks, pa.int32()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.list_(pa.int64())), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "part", "mask", "chars", "blocks", "digest"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, part string, mask int, chars long, blocks array<long>, digest binary")


def refined(rows: DataFrame) -> DataFrame:
    """(id, cls, ...) of those of rows (id, chars, blocks) whose class still has two members after all its blocks; cls has
    the length and a hash of all block hashes. One round for each block of the longest text that still has company."""
    now, k = rows.withColumn("cls", F.struct(F.col("chars").alias("size"), F.lit(0).cast("long").alias("at"))), 0
    while True:
        sizes = written(now.groupBy("cls").agg(F.count("*").alias("n"), F.max(F.size("blocks")).alias("deep")).where("n > 1"), "classes")
        most, deep = sizes.agg(F.max("n"), F.max("deep")).first()
        now = written(joined(now, sizes.select("cls"), "cls", "id", most or 0), "refined")
        if k >= (deep or 0):
            return now
        at = F.xxhash64("cls.at", F.coalesce(F.get("blocks", F.lit(k)), F.lit(0)))
        now, k = now.withColumn("cls", F.struct(F.col("cls.size").alias("size"), at.alias("at"))), k + 1


def duplicates(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of rows (signed) whose text a row with a smaller id has."""
    alive = refined(rows.where("id IS NOT NULL"))
    needed = written(alive.select(F.col("id").alias(id_col)).distinct(), "needed")
    hit = suspected(docs, id_col, needed)
    if hit is None:
        return rows.where("false")
    # whole texts are the keys: each task merges its own copies, and equal hashes of different texts don't meet
    texts = docs.where(hit).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least = texts.groupBy("text").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    least = written(least.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "least", "n"), "least")
    most = least.agg(F.max("n")).first()[0] or 0
    return joined(alive, least.drop("n"), "digest", "id", most).where(F.col("id") > F.col("least")).select(rows.columns)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n): n rows of that id and part fail the filters whose bits are set in mask; nearly always a row for each of docs."""
    rows = written(signed(docs, id_col, text_col, part_col), "signed")
    again = written(duplicates(docs, rows, id_col, text_col), "duplicates").select("id", "part", "mask")
    moved = again.withColumn("n", F.lit(-1)).unionByName(again.withColumn("mask", F.col("mask") + DUPLICATE).withColumn("n", F.lit(1)))
    every = rows.select("id", "part", "mask", F.lit(1).alias("n")).unionByName(moved)
    return every.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).where("n > 0")


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        out += [(name, step + 1, 1 << order[step], sum(1 << k for k in order[:step])) for step in range(len(order))]
    return out


def audit(failed: DataFrame, labels: DataFrame, label_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """The audit of failures (id, part, mask, n): a row for each part, order and step."""
    told = labels.select(F.col(label_id).alias("id"), (F.col(good) == 1).alias("good"), (F.col(toxic) == 1).alias("toxic")).where("id IS NOT NULL")
    told = told.groupBy("id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("good", "toxic")])
    kinds = failed.join(told, "id", "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "n")
    kinds = written(kinds.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), "masks")
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("filter_order", "step", "own", "before"), s)]) for s in orders()])
    each = kinds.select("*", F.explode(steps).alias("s")).select("part", "mask", "good", "toxic", "n", "s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    found = each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~gone & F.col("good")).alias("good_lost"),
        total(fails & ~gone & F.col("toxic")).alias("toxic_lost"), F.first("own").alias("own"),
    )
    found = written(found, "steps")
    share = found.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return found.join(share, ["part", "own"]).drop("own")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (removed by the step's filter, over all orders)."""
    return audit(failures(docs, id_col, text_col, part_col), labels)
