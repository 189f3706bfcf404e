"""Substring deduplication by recompression: words covered by a window of WINDOW words that an earlier document has too.

Names. A text is a sequence of names, at first one for each word. A round names runs (of four or more equal names, all but
the first and the last of them) and then pairs: each name falls to the left or the right side by a hash of the round, and a
left name followed by a right one becomes a new name. What a name becomes depends on it and its neighbours alone, so equal
substrings get equal names inside, in all documents. Near their ends the outside may take part; `rounds` therefore follows,
from every place, how far that reaches: the core of a window is what any text around it would leave as it is. Names are fingerprints of
what they stand for, so all tasks give the same ones and no table of names has to be sent.

The symbol of a window is the third level's: of the pairs of neighbouring names in its core the longest one, ties by hash.
After two rounds a core has at least two names (13 words lose at most 1 and 2 on either side, and a name has at most 4),
but for runs; a window whose core is too small is a symbol of its own. The symbol is a function of the window's words,
so a window that occurs twice has its symbol twice. Neighbouring windows mostly share theirs: such a block is one row.

Spark's rounds then work upwards from symbols to text:

1. symbols: rows meet by symbol; blocks whose symbol only one document has can't hold a repeat and end here;
2. blocks: of equal blocks (symbol and a second fingerprint of all words of the block, 128 bits in all) only those of
   the smallest id stay, the others are repeats whole; long repeats are settled here;
3. windows: of symbols whose blocks differ (at the ends of repeats) the blocks that stay are read again from their texts
   and compared window by window, by two fingerprints of their words.

A block that goes in round 2 needn't be compared in round 3: a document with a smaller id has all its windows.
Two fingerprints of 64 bits, from words hashed twice with other factors, stand for equal words throughout.

Hot symbols: rows of a batch whose symbol several of its documents have are known to be shared; one of them stays with
the symbol and the others are dealt to parts of it, so that rows of one symbol and part stay few: one for each batch, or a part
of the symbol's. What the parts keep, a row of each block, meets in a second step, in joins that split hot keys; windows likewise. Texts are shuffled for documents that have something to
compare or remove only, behind a Bloom filter of their keys.

Defined results for odd input: null or empty text has no words and keeps an empty text; texts under WINDOW words lose nothing; a window that occurs
only in one document, however often, stays; equal ids are not smaller than each other, so their rows don't remove each
other's words; a null id is larger than any other; repeated rows give a row each; long texts are named in pieces that
overlap by a window, with the same result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.bloom import suspected
from veritrail.llm.common import small_batches, written
from veritrail.llm.components import PARTS, joined

WINDOW = 13
ROUNDS = 2
#: Bytes of text that are named at once, and bytes from which a word is hashed by itself.
PIECE, LONG_WORD = 1 << 20, 64
#: Windows of a block at most; a row's place is first window * LONGEST + windows - 1.
LONGEST = 64
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(13)
_BYTES = _RANDOM.integers(0, 2**64, (2, 256), np.uint64)
_BASES = [int(b) | 5 for b in _RANDOM.integers(0, 2**63, 4, np.uint64) & ~np.uint64(7)]
_A, _B, _C = (np.uint64(int(x) | 1) for x in _RANDOM.integers(0, 2**64, 3, np.uint64))
_LOG = np.array([0, *(int(k).bit_length() - 1 for k in range(1, 64))], np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=16)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of an odd number and of its inverse, modulo 2^64."""
    made = []
    for b in (base, pow(base, -1, 2**64)):
        row = np.full(1 << bits, b, np.uint64)
        row[0] = 1
        made.append(np.multiply.accumulate(row))
    return made[0], made[1]


def ranges(values: np.ndarray, base: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The polynomial fingerprint of values[first:stop], for each of these (not empty)."""
    power, inverse = _powers(base, max(10, len(values).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)))
    return mixed((total[stop] - total[first]) * inverse[first])


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of each word."""
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = _WHITE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(white[1:] != white[:-1])
    return edges[0::2], edges[1::2]


def word_names(data: bytes, first: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Two fingerprints of each word."""
    raw = np.frombuffer(data, np.uint8)
    out = [ranges(_BYTES[k][raw], _BASES[k], first, stop) for k in range(2)]
    for k in np.flatnonzero(stop - first > LONG_WORD):
        value = xxhash.xxh3_128_intdigest(data[first[k] : stop[k]])
        out[0][k], out[1][k] = value >> 64, value & (2**64 - 1)
    return out


def rounds(names: np.ndarray, follows: np.ndarray, n_rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word) of what is left after the rounds, and for each place between words (before each word, after the
    last) the place where the core of a window that begins there begins, and where that of one that ends there ends.

    follows: whether the next word belongs to the same text."""
    n = len(names)
    start, begins, ends = np.arange(n), np.arange(n + 1), np.arange(n + 1)
    for k in range(1, n_rounds + 1):
        equal = np.append((names[1:] == names[:-1]), False) & follows
        if equal.any():
            names, start, follows, begins, ends = _runs(names, start, follows, equal, begins, ends, n)
        stop = np.append(start[1:], n)
        right = ((names * (_B + np.uint64(2 * k))) >> np.uint64(63)).astype(bool)
        after, before = np.arange(n + 1), np.arange(n + 1)
        after[start[right]] = stop[right]  # a right name may go with an unknown one before it
        before[stop[~right]] = start[~right]
        begins, ends = after[begins], before[ends]
        pair = np.flatnonzero(~right[:-1] & right[1:] & follows[:-1])
        new = names.copy()
        new[pair] = mixed(names[pair] * _B + names[pair + 1] * _C + np.uint64(k))
        follows = follows.copy()
        follows[pair] = follows[pair + 1]
        keep = np.ones(len(names), bool)
        keep[pair + 1] = False
        names, start, follows = new[keep], start[keep], follows[keep]
    return names, start, begins, ends


def _runs(names, start, follows, equal, begins, ends, n):
    """Names the inside of runs. A window that begins in a run may see its end only: its core begins with the last copy."""
    m = len(names)
    first = np.flatnonzero(~np.concatenate(([False], equal[:-1])))  # of each run, of one name or more
    size = np.diff(np.append(first, m))
    run = np.repeat(np.arange(len(first)), size)
    last = first + size - 1
    stop = np.append(start[1:], n)
    after, before = np.arange(n + 1), np.arange(n + 1)
    inner = np.flatnonzero(equal)
    after[start[inner]] = start[last[run[inner]]]
    later = inner + 1
    before[stop[later]] = stop[first[run[later]]]
    begins, ends = after[begins], before[ends]
    long = size >= 4
    names, follows, keep = names.copy(), follows.copy(), np.ones(m, bool)
    at = first[long] + 1  # stands for the copies first + 1 .. last - 1
    names[at] = mixed(names[at] * _C + size[long].astype(np.uint64) * _A)
    inside = np.arange(m) - first[run]
    keep[long[run] & (inside > 1) & (inside < size[run] - 1)] = False
    return names[keep], start[keep], follows[keep], begins, ends


def blocks(words: list[np.ndarray], text: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(symbol, fingerprint, first window, windows) of each block. words: two fingerprints for each word of several texts; text: of each word."""
    n = len(text)
    if n < window:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    names, start, begins, ends = rounds(words[0], np.append(text[1:] == text[:-1], False))
    place = np.zeros(n + 1, np.int64)
    place[start + 1] = 1
    place = np.cumsum(place)  # names that begin before a place
    size = np.diff(np.append(start, n))
    pairs = len(names) - 1
    at = np.flatnonzero(text[window - 1 :] == text[: n - window + 1])
    low = place[begins[at]]
    count = place[ends[at + window]] - 1 - low
    best = np.empty(len(at), np.uint64)
    whole = np.flatnonzero(count <= 0)
    best[whole] = ranges(words[0], _BASES[2], at[whole], at[whole] + window)
    some = np.flatnonzero(count > 0)
    if len(some):
        name = mixed(names[:-1] * _B + names[1:] * _C)
        key = (np.minimum(size[:-1] + size[1:], 63).astype(np.uint64) << np.uint64(58)) | (name >> np.uint64(6))
        tables = [key]  # the largest of 1, 2, 4, ... keys from each place on
        while 2 << len(tables) - 1 <= count.max():
            step, longer = 1 << len(tables) - 1, tables[-1].copy()
            np.maximum(longer[: pairs - step], tables[-1][step:], out=longer[: pairs - step])
            tables.append(longer)
        flat, level = np.concatenate(tables), _LOG[count[some]]
        from_ = level * pairs + low[some]
        best[some] = np.maximum(flat[from_], flat[from_ + count[some] - (1 << level)])
    new = np.append(True, (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.empty(0, bool)
    head = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(inside % LONGEST == 0)
    size = np.diff(np.append(head, len(at)))
    first = at[head]
    fingerprint = ranges(words[1], _BASES[3], first, first + size + window - 1)
    return best[head], fingerprint ^ size.astype(np.uint64) * _B, first, size


def pieces(texts: list[bytes], window: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in portions of about PIECE bytes: (bytes, first and stop of each word, its text's number, its number there).

    Several short texts share a portion; a long one is cut between words, and each part of it begins with the last
    window - 1 words of the one before."""
    held, size, number = [], 0, []
    for k, data in enumerate(texts):
        if len(data) > PIECE:
            first, stop = spans(data)
            i, j = 0, 0
            while j < len(first):
                j = min(len(first), max(int(np.searchsorted(first, first[i] + PIECE)), i + 2 * window))
                low = int(first[i])
                yield data[low : int(stop[j - 1])], first[i:j] - low, stop[i:j] - low, np.full(j - i, k), np.arange(i, j)
                i = j - window + 1
            continue
        held.append(data)
        number.append(k)
        size += len(data) + 1
        if size > PIECE:
            yield _together(held, number)
            held, size, number = [], 0, []
    if held:
        yield _together(held, number)


def _together(texts: list[bytes], number: list[int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = b"\n".join(texts)
    first, stop = spans(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    own = np.searchsorted(ends, first, "right")
    counts = np.bincount(own, minlength=len(texts))
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return data, first, stop, np.array(number)[own], np.arange(len(first)) - begin[own]


def _shared(symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a symbol is in several rows, the part it is dealt to): 0, but for all rows of a shared symbol after its first."""
    order = np.lexsort((row, symbol))
    by, own = symbol[order], row[order]
    head = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.empty(0, np.int64)
    size = np.diff(np.append(head, len(by)))
    many = own[head] != own[head + size - 1] if len(by) else np.empty(0, bool)
    known, part = np.empty(len(by), bool), np.empty(len(by), np.int32)
    known[order] = np.repeat(many, size)
    place = np.arange(len(by)) - np.repeat(head, size)
    part[order] = np.where(np.repeat(many, size) & (place > 0), 1 + (own * 31 + place) % (PARTS - 1), 0)
    return known, part


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _dealt(batch: pa.RecordBatch, made: list[list[np.ndarray]]) -> pa.RecordBatch:
    """(one, two, at, id, copy, known, part) of made: one, two, at, row of the batch, in portions."""
    one, two, at, row = (np.concatenate([*x, np.empty(0, t)]).astype(t) for x, t in zip(made, (np.uint64, np.uint64, np.int64, np.int64)))
    known, part = _shared(one, row)
    own = [batch.column(k).take(pa.array(row)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([_signed(one), _signed(two), pa.array(at), *own, pa.array(known), pa.array(part)], names=_FIELDS)


_FIELDS = ["one", "two", "at", "id", "copy", "known", "part"]


def _schema(rows: DataFrame) -> str:
    return f"one long, two long, at long, id {rows.schema['id'].dataType.simpleString()}, copy long, known boolean, part int"


def symbols(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """_FIELDS, one being the symbol and two the fingerprint of each block of rows (id, copy, text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[np.ndarray]] = [[], [], [], []]
            for data, first, stop, text, number in pieces([x.as_py() or b"" for x in batch.column(2)], window):
                symbol, block, at, size = blocks(word_names(data, first, stop), text, window)
                for column, part in zip(made, (symbol, block, number[at] * LONGEST + size - 1, text[at])):
                    column.append(part)
            yield _dealt(batch, made)

    return rows.mapInArrow(run, _schema(rows))


def windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """_FIELDS, one and two being fingerprints of each window of the blocks that rows (id, copy, text binary, ats array<long>) name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list[np.ndarray]] = [[], [], [], []]
            for k in range(batch.num_rows):
                ats = batch.column(3)[k].values.to_numpy()
                size = ats % LONGEST + 1
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                wanted = np.unique(np.repeat(ats // LONGEST, size) + inside)
                for data, first, stop, _, number in pieces([batch.column(2)[k].as_py()], window):
                    if not len(number):
                        continue
                    own = wanted[np.searchsorted(wanted, number[0]) : np.searchsorted(wanted, number[-1] - window + 2)]
                    wanted = wanted[np.searchsorted(wanted, number[-1] - window + 2) :]
                    names, at = word_names(data, first, stop), own - number[0]
                    for column, part in zip(made, (*(ranges(names[j], _BASES[2 + j], at, at + window) for j in range(2)), own * LONGEST, np.full(len(own), k))):
                        column.append(part)
            yield _dealt(batch, made)

    return rows.mapInArrow(run, _schema(rows))


def _several(least: Column, most: Column, null: Column) -> Column:
    """Whether ids with this least and greatest one, and a null one or not, differ."""
    return (least < most) | (least.isNotNull() & null)


def _after(least: Column) -> Column:
    return least.isNotNull() & (F.col("id").isNull() | (F.col("id") > least))


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.struct("id", "copy").alias("doc")).agg(F.collect_list("at").alias("ats"))


def settled_blocks(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of symbols' rows (id, copy, at): the blocks that an earlier document has whole, and those to be compared by window.

    Where all rows of a symbol meet (no batch has it twice), one pass over them, sorted by symbol and block, settles it. Of
    symbols that are dealt out each part keeps a row of each block and id; those few meet in a second step."""
    met = found.repartition("one", "part").sortWithinPartitions("one", "part", "two")
    block, symbol, null = Window.partitionBy("one", "part", "two"), Window.partitionBy("one", "part"), F.col("id").isNull()
    first = met.withColumn("least", F.min("id").over(block))
    seen = first.select(
        "id", "copy", "one", "two", "at", _after(F.col("least")).alias("again"), F.max("known").over(symbol).alias("hot"),
        _several(F.min("id").over(symbol), F.max("id").over(symbol), F.max(null).over(symbol)).alias("shared"),
        _several(F.min("least").over(symbol), F.max("least").over(symbol), F.max(F.col("least").isNull()).over(symbol)).alias("open"),
    )
    live = written(seen.where("again OR hot OR (shared AND open)").drop("shared"), "live")
    heads = live.where("hot AND NOT again").select("id", "copy", "one", F.struct("one", "two").alias("key"), "at")
    kinds = written(heads.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")), "kinds")
    differ = _several(F.min("least"), F.max("least"), F.bool_or(F.col("least").isNull()))
    open_ = written(kinds.groupBy(F.col("key.one").alias("one")).agg(differ.alias("open"), F.sum("n").alias("n")).where("open").drop("open"), "open")
    placed = joined(heads, kinds.drop("n"), "key", "id", kinds.agg(F.max("n")).first()[0] or 0)
    later = _after(F.col("least"))
    again = live.where("again").select("id", "copy", "at").unionByName(placed.where(later).select("id", "copy", "at"))
    rest = joined(placed.where(~later), open_.drop("n"), "one", "id", open_.agg(F.max("n")).first()[0] or 0).select("id", "copy", "at")
    return again, live.where("NOT hot AND NOT again").select("id", "copy", "at").unionByName(rest)


def settled_windows(found: DataFrame) -> DataFrame:
    """Of windows' rows (id, copy, at): those that an earlier document has, in the same two steps."""
    over = Window.partitionBy("one", "two", "part")
    seen = found.select("id", "copy", "one", "two", "at", _after(F.min("id").over(over)).alias("again"), F.max("known").over(over).alias("hot"))
    live = written(seen.where("again OR hot"), "windows")
    heads = live.where("hot AND NOT again").select("id", "copy", F.struct("one", "two").alias("key"), "at")
    least = written(heads.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")), "least")
    placed = joined(heads, least.drop("n"), "key", "id", least.agg(F.max("n")).first()[0] or 0)
    return live.where("again").select("id", "copy", "at").unionByName(placed.where(_after(F.col("least"))).select("id", "copy", "at"))


def repeats(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc: struct of id and copy, ats): the places of repeated blocks and windows of each of rows (id, copy, text binary) that has any."""
    again, rest = settled_blocks(symbols(rows, window))
    rest = written(_by_document(rest), "rest")
    return written(_by_document(again.unionByName(settled_windows(windows(_texts(rows, rest), window)))), "repeats")


def _texts(rows: DataFrame, ats: DataFrame) -> DataFrame:
    """(id, copy, text, ats) of those of rows that ats (doc, ats) has."""
    keyed = rows.withColumn("doc", F.struct("id", "copy"))
    hit = suspected(keyed, "doc", ats.select("doc"))
    keyed = keyed.where("false") if hit is None else keyed.where(hit)
    return keyed.join(ats, "doc").select("id", "copy", "text", "ats")


def kept(data: bytes, ats: np.ndarray | None, window: int = WINDOW) -> tuple[int, int, bytes]:
    """(words, words removed, the others joined by one space)."""
    words = data.split()
    if ats is None or not len(ats):
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, ats // LONGEST, 1)
    np.add.at(change, ats // LONGEST + ats % LONGEST + window, -1)
    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return len(words), len(words) - len(stay), b" ".join([words[k] for k in stay.tolist()])


def _cleaned(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [kept(text.as_py() or b"", ats.values.to_numpy() if ats.is_valid else None, window) for text, ats in zip(batch.column(1), batch.column(2))]
            columns = list(zip(*made)) or [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "n_words", "n_removed", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "text", "ats").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept binary")
    return found.withColumn("kept", F.col("kept").cast("string"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id_col, n_words, n_removed, kept (the words that stay, joined by one space) for each row of docs."""
    small_batches(docs.sparkSession)
    again = docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    copy = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if again else F.lit(0).cast("long")  # tells rows of one id apart
    rows = docs.select(F.col(id_col).alias("id"), copy.alias("copy"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found = repeats(rows, window)
    keyed = rows.withColumn("doc", F.struct("id", "copy"))
    hit = suspected(keyed, "doc", found.select("doc"))
    none = F.lit(None).cast("array<long>").alias("ats")
    out = _cleaned((keyed if hit is None else keyed.where(~hit)).select("id", "text", none), window)
    if hit is not None:
        out = out.unionByName(_cleaned(keyed.where(hit).join(found, "doc", "left"), window))
    return out.withColumnRenamed("id", id_col)
