"""Token counts of fields or sections by offset-mapped attribution.

A whole document is encoded once. Each token's bytes give its span of characters (a token that begins or ends inside a
character's bytes reaches over the whole character). Sections are spans of characters; they cut the text into sorted
intervals, and tokens meet these in an interval join by binary search. A token over a boundary is allocated by an explicit
rule:

* "start": to the section of its first character;
* "most": to the section with most of its characters, ties to the earlier one;
* "share": to each section in proportion to its characters.

Counts of all sections and of the part outside any (section null) add up to the document's tokens under every rule.

Defined results for odd input: null or empty text has no tokens and, by lines, no section; a character in several
sections belongs to the first listed; sections that reach outside the text are cut to it, empty ones get no token;
very long texts are encoded in blocks cut where no token can span, so that memory for tokens is a few numbers each; repeated
rows are counted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.bpe import blocks, read_ranks
from veritrail.llm.common import small_batches

RULES = ("start", "most", "share")
#: Rows of a document's result that leave a task at once.
ROWS = 1 << 16


_LONG_RUN = regex.compile(r"\s{50000}")


class Counter:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def ids(self, part: str) -> list[int]:
        """The tokens of a text. A very long run of white space is too much for the library's matching, so such a text is cut into pieces here."""
        if not _LONG_RUN.search(part):
            return self.encoding.encode_ordinary(part)
        return [i for m in self.pattern.finditer(part) for i in self.encoding._encode_single_piece(m.group().encode())]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The first character of each token, and the one after its last. A long text is encoded in blocks."""
        firsts, stops, before = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for part in blocks(text):
            ids = np.array(self.ids(part), np.int64)
            stop = np.cumsum(self.size[ids])
            data = np.frombuffer(part.encode(), np.uint8)
            character = np.cumsum((data & 0xC0) != 0x80) - 1 + before
            firsts.append(character[stop - self.size[ids]])
            stops.append(character[stop - 1] + 1)
            before += len(part)
        return np.concatenate(firsts), np.concatenate(stops)


class Sections:
    """Spans of characters, in the order given: arrays of first characters and of those after the last, and titles."""

    def __init__(self, first: np.ndarray, stop: np.ndarray, titles: pa.Array):
        self.first, self.stop, self.titles = first, stop, titles

    def __len__(self) -> int:
        return len(self.first)

    @classmethod
    def of(cls, spans: list[tuple], n_chars: int) -> Sections:
        first, stop = (np.array([min(s[k] or 0, n_chars) for s in spans], np.int64) for k in (1, 2))
        return cls(first, stop, pa.array([s[0] for s in spans], pa.string()))


def lines(text: str) -> Sections:
    """A section for each line, with its line end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.flatnonzero(points == 10) + 1
    if len(text) and (not len(stop) or stop[-1] < len(text)):
        stop = np.append(stop, len(text))
    first = np.concatenate(([0], stop[:-1])) if len(stop) else stop
    titles = pc.binary_join_element_wise("line", pa.array(np.arange(1, len(stop) + 1)).cast(pa.string()), " ")
    return Sections(first, stop, titles)


def intervals(n_chars: int, sections: Sections) -> tuple[np.ndarray, np.ndarray]:
    """(starts, owners): the text as intervals of one owner each, in order; the owner is the first section listed that holds
    the interval, or len(sections). Neighbours of the same owner are one interval."""
    first, stop = np.clip(sections.first, 0, n_chars), np.clip(sections.stop, 0, n_chars)
    cuts = np.unique(np.concatenate(([0], first, stop)))
    cuts = cuts[cuts < max(1, n_chars)]
    owner = np.full(len(cuts), len(sections), np.int64)
    begin, end = np.searchsorted(cuts, first), np.searchsorted(cuts, stop)
    if len(sections) and (begin[1:] >= end[:-1]).all() and (end >= begin).all():  # in order and apart: no section hides another
        size = end - begin
        owner[np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(np.arange(len(sections)), size)
    else:
        for k in range(len(sections) - 1, -1, -1):
            owner[begin[k] : end[k]] = k
    new = np.concatenate(([True], owner[1:] != owner[:-1]))
    return cuts[new], owner[new]


def attributed(first: np.ndarray, stop: np.ndarray, n_chars: int, sections: Sections, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens over a boundary) for each section and, last, for what lies outside: a join of the sorted spans of
    tokens with the sorted intervals of sections by binary search. Work grows with tokens and intervals that meet."""
    outside = len(sections)
    starts, owner = intervals(n_chars, sections)
    if not len(first):
        return np.zeros(outside + 1), np.zeros(outside + 1, np.int64)
    low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, stop - 1, "right") - 1
    over = low != high
    counts = np.bincount(owner[low[~over]], minlength=outside + 1).astype(np.float64)
    if not over.any():
        return counts, np.zeros(outside + 1, np.int64)
    first, stop, low, size = first[over], stop[over], low[over], (high - low)[over] + 1
    head = np.cumsum(size) - size
    token = np.repeat(np.arange(len(size)), size)  # a row for each token and interval that meet
    at = np.repeat(low - head, size) + np.arange(size.sum())
    chars = np.minimum(np.append(starts[1:], n_chars)[at], stop[token]) - np.maximum(starts[at], first[token])
    pair, back = np.unique(token * (outside + 1) + owner[at], return_inverse=True)
    met, token_of, owner_of = np.bincount(back, weights=chars), pair // (outside + 1), pair % (outside + 1)
    crossing = np.bincount(owner_of, minlength=outside + 1)
    if rule == "start":
        counts += np.bincount(owner[low], minlength=outside + 1)
    elif rule == "most":
        own = met[back]
        best = np.flatnonzero(own == np.repeat(np.maximum.reduceat(own, head), size))
        earliest = best[np.concatenate(([True], token[best][1:] != token[best][:-1]))]
        counts += np.bincount(owner[at[earliest]], minlength=outside + 1)
    else:
        total = np.bincount(token_of, weights=met)
        counts += np.bincount(owner_of, weights=met / total[token_of], minlength=outside + 1)
    return counts, crossing


def _shown(row: int, own: Sections, counts: np.ndarray, crossing: np.ndarray, low: int, high: int) -> list[pa.Array]:
    """The columns of the result's rows low .. high for one document; the row after the sections is what lies outside."""
    inner = slice(low, min(high, len(own)))
    rest = pa.nulls(high - low - len(own.first[inner]), pa.int32())
    with_rest = lambda values: pa.concat_arrays([pa.array(values.astype(np.int32)), rest])
    titles = pa.concat_arrays([own.titles.slice(low, high - low - len(rest)), rest.cast(pa.string())])
    return [pa.array(np.full(high - low, row)), with_rest(np.arange(low, inner.stop)), titles, with_rest(own.first[inner]), with_rest(own.stop[inner]), pa.array(counts[low:high]), pa.array(crossing[low:high])]


def _batch(ids: pa.Array, held: list[list[pa.Array]]) -> pa.RecordBatch:
    row, *others = (pa.concat_arrays(x) for x in held)
    return pa.RecordBatch.from_arrays([ids.take(row), *others], names=["id", "section_no", "section", "first_char", "end_char", "n_tokens", "n_crossing"])


_at_hand: dict[str, Counter] = {}


def token_counts(
    docs: DataFrame, vocab_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None,
    rule: str = "start",
) -> DataFrame:
    """id_col, section_no (null: outside), section, first_char, end_char, n_tokens, n_crossing.

    sections_col: an array of structs (name, start, end) in characters; without it each line is a section. Under the
    rules "start" and "most" n_tokens is a whole number (as double).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocab_file, "rb") as f:
        data = f.read()
    shared, name = spark.sparkContext.broadcast(data), hashlib.sha256(data + pattern.encode()).hexdigest()
    empty = F.lit(None).cast("array<struct<name:string,start:int,end:int>>")
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), (F.col(sections_col) if sections_col else empty).alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _at_hand.get(name)
        if counter is None:
            counter = _at_hand[name] = Counter(read_ranks(shared.value.split(b"\n")), pattern)
        for batch in batches:
            held: list[list[pa.Array]] = [[] for _ in range(7)]
            rows = 0
            for k in range(batch.num_rows):
                text = (batch.column(1)[k].as_py() or b"").decode("utf-8", "replace")
                own = Sections.of([tuple(s.values()) for s in batch.column(2)[k].as_py() or [] if s], len(text)) if sections_col else lines(text)
                first, stop = counter.spans(text) if text else (np.empty(0, np.int64),) * 2
                counts, crossing = attributed(first, stop, len(text), own, rule)
                shown = len(own) + bool(counts[-1] or crossing[-1])
                for low in range(0, shown, ROWS):
                    high = min(low + ROWS, shown)
                    for column, part in zip(held, _shown(k, own, counts, crossing, low, high)):
                        column.append(part)
                    rows += high - low
                    if rows >= ROWS:
                        yield _batch(batch.column(0), held)
                        held, rows = [[] for _ in range(7)], 0
            if rows:
                yield _batch(batch.column(0), held)

    id_type = picked.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, section_no int, section string, first_char int, end_char int, n_tokens double, n_crossing long"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
