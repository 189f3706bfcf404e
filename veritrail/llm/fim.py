"""Fill-in-the-middle transformation over a distinct-text index.

Identical texts are grouped by their content: rows whose 128-bit key occurs more than once go through a grouping by the
text itself, which compares whole texts, and each group's text is indexed once. Its entry is an Elias-Fano list of the
bytes after which tokens end: n numbers under u take about n * (2 + log2(u / n)) bits, and any of them is read by one
select. The entry is joined back to the group's documents by SHA-256 and length of the text, and each document's two cuts, drawn
from a hash of its id, are two selects. A text that occurs once is an entry of its own and is cut where it is, so it is
never shuffled. A group may hold any share of all rows: its documents travel as ids and digests, dealt in parts.

A token is a run of ASCII white space (or none) and the word after it; white space after the last word is a token.
Units 0 .. n are cut at places drawn for the document; the parts are prefix, middle and suffix. Forms:

* "plain": the text (if the text is empty or holds a marker, or the draw says so);
* "psm": <P>prefix<S>suffix<M>middle;
* "spm": <S>suffix<P>prefix<M>middle.

Defined results for odd input: null text counts as empty; an empty text is plain and has no tokens; text of white space
only is one token; the draw of a null id is that of the text "null"; repeated ids draw the same cuts of their own texts,
repeated rows give a row each; very long texts are indexed in blocks, whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.bloom import suspected
from veritrail.llm.common import small_batches, written
from veritrail.llm.components import joined

#: Percent of documents that are transformed, and of these in the order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
SEED = 42
MARKERS = ("<P>", "<S>", "<M>")
_MARKED = re.compile(rb"<[PSM]>")
_BLOCK = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def boundaries(data: bytes) -> np.ndarray:
    """The bytes of a UTF-8 text after which a token ends, in order; the last is the text's length."""
    ends, before = [], True
    for at in range(0, len(data), _BLOCK):
        white = _WHITE[np.frombuffer(data, np.uint8, min(_BLOCK, len(data) - at), at)]
        last = np.concatenate(([before], white[:-1]))
        ends.append(np.flatnonzero(white & ~last) + at)
        before = bool(white[-1])
    if data:
        ends.append(np.array([len(data)]))
    return np.concatenate(ends) if ends else np.empty(0, np.int64)


class EliasFano:
    """A list of n rising numbers under u: low bits of each packed side by side, high bits as gaps in a bit map."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        low_bits = max(0, int((values[-1] + 1) // n).bit_length() - 1) if n else 0
        # each number's bit in the map comes after as many zeros as its high part tells
        high = np.zeros((int(values[-1] >> low_bits) + n if n else 0) // 64 * 64 + 64, np.uint8)
        high[(values >> low_bits) + np.arange(n)] = 1
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little").view(np.uint64))

    def select(self, k: int) -> int:
        """The k-th number, from 0."""
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        word = int(np.searchsorted(ones, k, "right"))
        inside = np.unpackbits(self.high[word : word + 1].view(np.uint8), bitorder="little")
        place = 64 * word + int(np.flatnonzero(inside)[k - (int(ones[word - 1]) if word else 0)])
        first = k * self.low_bits
        own = np.unpackbits(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], bitorder="little")[first & 7 :][: self.low_bits]
        return (place - k) << self.low_bits | int(own @ (1 << np.arange(self.low_bits)))

    def packed(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.low)], np.int64).tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> EliasFano:
        n, low_bits, size = np.frombuffer(data, np.int64, 3).tolist()
        return cls(n, low_bits, np.frombuffer(data, np.uint8, size, 24), np.frombuffer(data[24 + size :], np.uint64))


def entry(data: bytes) -> bytes:
    return EliasFano.of(boundaries(data)).packed()


def cut(data: bytes, index: EliasFano, draw: list[int]) -> tuple[str, bytes, bytes, bytes]:
    """(form, prefix, middle, suffix) by four drawn numbers; a plain text is all prefix."""
    if not data or _MARKED.search(data) or draw[2] % 100 >= RATE:
        return "plain", data, b"", b""
    units = sorted((draw[0] % (index.n + 1), draw[1] % (index.n + 1)))
    first, second = (index.select(u - 1) if u else 0 for u in units)
    return ("spm" if draw[3] % 100 < SPM_RATE else "psm"), data[:first], data[first:second], data[second:]


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "plain":
        return prefix
    p, s, m = (x.encode() for x in MARKERS)
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def draws(id_: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers for an id: the first groups of the SHA-256 of seed, colon and id in decimal."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone: its parts hold no marker."""
    parts = F.split(output, "<[PSM]>", -1)
    order = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(order)


_FIELDS = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]


def _cut_all(rows: DataFrame) -> DataFrame:
    """_FIELDS for each of rows (id, draw, text binary, entry: null where the text has to be indexed here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _FIELDS[1:]]
            for k in range(batch.num_rows):
                data, packed = batch.column(2)[k].as_py() or b"", batch.column(3)[k].as_py()
                index = EliasFano.unpacked(entry(data) if packed is None else packed)
                form, prefix, middle, suffix = cut(data, index, batch.column(1)[k].as_py())
                chars = [None, None] if form == "plain" else [len(x.decode("utf-8", "replace")) for x in (prefix, middle)]
                for column, value in zip(out, [index.n, form, *chars, arranged(form, prefix, middle, suffix)]):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(out, kinds)]], names=_FIELDS)

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def index_of(texts: DataFrame) -> DataFrame:
    """(digest, size, text, entry): a row for each distinct text of texts (text), grouped by comparing texts whole; each
    task merges its own copies before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([entry(x.as_py()) for x in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["text", "entry"])

    distinct = texts.groupBy("text").agg(F.count("*").alias("n")).select(F.col("text").cast("binary").alias("text"))
    made = distinct.mapInArrow(run, "text binary, entry binary")
    return made.select(F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"), "text", "entry")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """id_col, n (tokens), form, prefix_chars, middle_chars (null if plain), output (text) for each row of docs."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit("t"), text).alias("g")).alias("key"))
    counts = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    hit = suspected(rows, "key", counts.select("key"))
    single = rows if hit is None else rows.where(~hit)
    out = _cut_all(single.select("id", draws(F.col("id"), seed).alias("draw"), F.col("text").cast("binary").alias("text"), F.lit(None).cast("binary").alias("entry")))
    if hit is not None:
        copies = rows.where(hit)
        entries = index_of(copies.select("text")).select(F.struct("digest", "size").alias("content"), "text", "entry")
        own = F.struct(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("size"))
        most = counts.agg(F.max("n")).first()[0]
        back = joined(copies.select("id", own.alias("content")), entries, "content", "id", most)
        out = out.unionByName(_cut_all(back.select("id", draws(F.col("id"), seed).alias("draw"), "text", "entry")))
    return out.withColumnRenamed("id", id_col)
