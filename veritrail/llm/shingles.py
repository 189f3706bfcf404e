"""Word shingles of whole texts as XXH64 hashes, their MinHash bands, and exact Jaccard similarity of pairs of texts.

A-Z is lower-cased; words are runs of anything but ASCII white space. A text of fewer words than a shingle has its whole
word sequence as the only shingle, one without words has none. Long texts are walked in blocks, so memory doesn't grow
with them but for the hashes themselves where a set of them is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.bloom import suspected
from veritrail.llm.common import apart, written

SEED = 42
BANDS, ROWS = 20, 5
PERMS = BANDS * ROWS
#: 64-bit words of a text's map of shingles.
WORDS = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK, _BLOCK = 1 << 16, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_FACTORS, _FLIPS = np.random.default_rng(SEED).integers(0, 2**64, (2, PERMS), np.uint64)
_FACTORS |= np.uint64(1)


def _blocks(data: bytes) -> Iterator[bytes]:
    """data in parts of about _BLOCK bytes, cut before white space."""
    at = 0
    while len(data) - at > _BLOCK:
        cut = _SPACE.search(data, at + _BLOCK)
        if cut is None:
            break
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:]


def hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a UTF-8 text's shingles, repeats included, in parts; each block begins with the last words of the one before."""
    digest, words, many = xxhash.xxh64_intdigest, [], False
    for block in _blocks(text or b""):
        words = (words[-(shingle - 1) :] if shingle > 1 else []) + block.translate(_LOWER).split()
        count = len(words) - shingle + 1
        if count <= 0:
            continue
        many = True
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        for k in range(0, count, _CHUNK):
            yield np.array([digest(joined[i:j], SEED) for i, j in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK])], np.uint64)
    if not many and words:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The set of parts' hashes, sorted."""
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def bands(found: np.ndarray) -> list[int]:
    """The keys of a set's MinHash bands, as signed numbers: ROWS of PERMS minima each."""
    least = np.full(PERMS, 2**64 - 1, np.uint64)
    for k in range(0, len(found), 1024):
        np.minimum(least, ((found[k : k + 1024] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[ROWS * i : ROWS * (i + 1)].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two sets' Jaccard similarity is at least the fraction least; two empty sets are similar."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * both >= least[0] * (len(a) + len(b) - both)


def fetched(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of texts (cls, text binary) whose cls is in needed (cls, distinct), one for each, written. Only these are
    shuffled: a Bloom filter of the keys, of at most SPARING_BITS, rejects nearly all others where they are."""
    hit = suspected(texts, "cls", needed)
    found = texts.where("false") if hit is None else texts.where(hit).dropDuplicates(["cls"]).join(needed, "cls", "left_semi")
    return written(found, "texts")


def linked(texts: DataFrame, pairs: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b), keys of texts (cls, text binary; one row for each), that are similar."""
    one, other = (texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = lru_cache(64)(lambda text: distinct(list(hashes(text, shingle))))
        for batch in batches:
            keep = [similar(last(x.as_py()), last(y.as_py()), least) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(apart(one), "a").join(apart(other), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def own_shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """(cls, own): how many of a text's shingles no other of texts (cls, text binary) has; texts without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = distinct(list(hashes(batch.column(1)[k].as_py(), shingle))).view(np.int64)
                for at in range(0, len(found), _CHUNK):
                    part = pa.array(found[at : at + _CHUNK])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column(0)[k].as_py(), np.int64)), part], names=["cls", "h"])

    grams = texts.select("cls", "text").mapInArrow(run, "cls long, h long")
    alone = grams.groupBy("h").agg(F.count("*").alias("n"), F.min("cls").alias("cls")).where("n = 1")
    return alone.groupBy("cls").agg(F.count("*").alias("own"))


def bitmaps(texts: DataFrame, shingle: int) -> DataFrame:
    """(cls, bits array<long>): a bit for each shingle of texts (cls, text binary) by its hash, 64 * WORDS in all. A bit that one
    text has and another lacks is a shingle that only the first has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1):
                bits = np.zeros(64 * WORDS, np.uint8)
                for part in hashes(text.as_py(), shingle):
                    bits[part % np.uint64(len(bits))] = 1
                made.append(np.packbits(bits).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["cls", "bits"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, bits array<long>")
