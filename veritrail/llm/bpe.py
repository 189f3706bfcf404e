"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that its encoding ends with. Storing that last token for each
prefix gives the whole encoding by walking back from the end, costs a bounded number of tests a byte (no merge queue, so
a piece of any length is linear), and makes appends exact: a longer piece only adds places. A token t is the last one of
a prefix if it is a suffix of it and the pair (last token of what precedes, t) is one that BPE would leave unmerged; the
pair test undoes merges of both sides in the order of their ranks and looks for an earlier merge across the seam.

Text is cut by the vocabulary's pattern first; pieces are encoded separately. A piece that is itself a token is that token.

Defined results for odd input: null and empty texts encode to no ids; invalid UTF-8 is read with replacement characters;
repeated rows are encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import small_batches

#: Entries of a worker's memory of pieces, prefixes and pairs; beyond it the memory is emptied. Results don't depend on it.
REMEMBER = 250_000


def blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """text in parts of about `size` characters, each cut before a blank that follows something else than white space:
    no piece of the pattern holds such a place inside, and none looks back over it."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.merges: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.usable: dict[bytes, int] = {}
        self.joins: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.ends: dict[bytes, int] = {}
        self._learn_merges()

    def _learn_merges(self) -> None:
        """Finds the merge that makes each token: in order of rank, the two last tokens that encoding its bytes by the
        merges before it leaves. A token that they don't leave as a pair is never made by merging; only a whole piece is it."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.split[rank] = (rank, rank)
                self.usable[token] = rank
                continue
            made = self._walk(token)
            if len(made) == 2 and (made[0], made[1]) not in self.merges:
                self.merges[made[0], made[1]] = rank
                self.split[rank] = (made[0], made[1])
                self.usable[token] = rank
            self.joins.clear()

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side unmerged, each having been made by its own merges."""
        known = self.joins.get((left, right))
        if known is None:
            if len(self.joins) > REMEMBER:
                self.joins.clear()
            known = self.joins[left, right] = self._unmerged(left, right)
        return known

    def _unmerged(self, left: int, right: int) -> bool:
        # `before`: merges of this rank and later would come too late, as the tokens at the seam are already gone
        before = 1 << 60
        a, b = left, right
        while True:
            across = self.merges.get((a, b))
            if across is not None and across < before:
                return False
            # undo the later of the two merges; a tie of ranks (the same token twice) undoes the right one first
            if a > b:
                before, a = a, self.split[a][1]
                if a == before:
                    if self.split[b][0] == b:
                        return True
                    before, b = b + 1, self.split[b][0]
            else:
                before, whole = b + 1, b
                b = self.split[b][0]
                if b == whole:
                    if self.split[a][0] == a:
                        return True
                    before, a = a, self.split[a][1]

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix of piece; known: those of its first prefixes, which are kept."""
        last = list(known or [])
        usable, stays, longest = self.usable, self.stays, self.longest
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = usable.get(piece[start:end])
                if token is not None and (start == 0 or stays(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def walked(self, last: list[int]) -> list[int]:
        """The encoding of the whole, from the last token of each prefix."""
        out, end, size = [], len(last), self.bytes_of
        while end:
            out.append(last[end - 1])
            end -= len(size[out[-1]])
        return out[::-1]

    def _walk(self, piece: bytes) -> list[int]:
        return self.walked(self.last_tokens(piece))

    def _last(self, piece: bytes, before: int | None) -> int:
        """The last token of piece, whose shorter prefixes are in self.ends; before: that of the prefix one byte shorter.

        Only one suffix can be the last token, so the order of the tests is free: a longer form of `before` and the
        single byte come first, being right most often."""
        usable, ends, stays = self.usable, self.ends, self.stays
        size = len(piece)
        if before is not None:
            start = size - 1 - len(self.bytes_of[before])
            token = usable.get(piece[start:])
            if token is not None and (start == 0 or stays(ends[piece[:start]], token)):
                return token
            token = usable[piece[-1:]]
            if stays(before, token):
                return token
        for start in range(max(0, size - self.longest), size):
            token = usable.get(piece[start:])
            if token is not None and (start == 0 or stays(ends[piece[:start]], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(data) > 64:
            return tuple(self._walk(data))
        # short pieces share prefixes with each other: the table of last tokens is kept across pieces
        ends = self.ends
        if len(ends) > 2 * REMEMBER:
            ends.clear()
        at = len(data)
        while at and data[:at] not in ends:
            at -= 1
        token = ends[data[:at]] if at else None
        for end in range(at + 1, len(data) + 1):
            prefix = data[:end]
            token = ends[prefix] = self._last(prefix, token)
        out, end = [], len(data)
        while end:
            token = ends[data[:end]]
            out.append(token)
            end -= len(self.bytes_of[token])
        return tuple(out[::-1])

    blocks = staticmethod(blocks)

    def encode(self, text: str) -> list[int]:
        known, pieces = self.pieces, self.pattern.findall(text)
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > REMEMBER:
                known.clear()
            for k, piece in enumerate(pieces):
                if out[k] is None:
                    out[k] = known.get(piece) or self.piece_ids(piece)
                    if len(piece) <= 64:
                        known[piece] = out[k]
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Edited:
    """A text with its encoding, kept exact under appends and edits.

    Matches of the pattern depend on the text from their start on, so an edit leaves the pieces that end before it (by
    more than the two characters that the pattern looks ahead) and, once a new match starts where an old one did, all
    that follow. In a piece that grows, the last tokens of the prefixes that stay are kept, and only later ones are found.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.v, self.text = vocabulary, ""
        self.spans: list[tuple[int, int]] = []
        self.tables: list[list[int]] = []
        self.edit(0, 0, text)

    def _table(self, piece: str, like: str = "", table: list[int] | None = None) -> list[int]:
        a, b = piece.encode(), like.encode()
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return self.v.last_tokens(a, (table or [])[:same])

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, put: str) -> None:
        """Replaces text[start:stop] by put."""
        old, shift = self.text, len(put) - (stop - start)
        self.text = old[:start] + put + old[stop:]
        keep = 0
        while keep < len(self.spans) and self.spans[keep][1] + 1 < start:
            keep += 1
        spans, tables = self.spans[:keep], self.tables[:keep]
        starts = {a + shift: k for k, (a, _) in enumerate(self.spans) if a >= stop}
        reuse = {a: k for k, (a, _) in enumerate(self.spans) if k >= keep and a <= start}
        for m in self.v.pattern.finditer(self.text, spans[-1][1] if spans else 0):
            if m.start() >= start + len(put) and m.start() in starts:
                k = starts[m.start()]
                spans += [(a + shift, b + shift) for a, b in self.spans[k:]]
                tables += self.tables[k:]
                break
            k = reuse.get(m.start())
            like = old[slice(*self.spans[k])] if k is not None else ""
            spans.append(m.span())
            tables.append(self._table(m.group(), like, self.tables[k] if k is not None else None))
        self.spans, self.tables = spans, tables

    @property
    def ids(self) -> list[int]:
        out: list[int] = []
        for (a, b), table in zip(self.spans, self.tables):
            whole = self.v.ranks.get(self.text[a:b].encode())
            out += [whole] if whole is not None else self.v.walked(table)
        return out


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}


@lru_cache(maxsize=2)
def _vocabulary(data: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(data.split(b"\n")), pattern)


_at_hand: dict[str, Vocabulary] = {}


def encode_decode(docs: DataFrame, vocab_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of each row (with keep_ids also ids). vocab_file: a rank file that
    the driver can read; its bytes (under 2 MB) are broadcast, so executors need no such file."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    with open(vocab_file, "rb") as f:
        data = f.read()
    shared, name = spark.sparkContext.broadcast(data), hashlib.sha256(data + pattern.encode()).hexdigest()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _at_hand.get(name)
        if v is None:
            v = _at_hand[name] = _vocabulary(shared.value, pattern)
        text_of = v.text_of.__getitem__
        for batch in batches:
            count, coded, decoded, kept = [], [], [], []
            for text in batch.column(1):
                n, told, back, held = 0, hashlib.sha256(), hashlib.sha256(), []
                for part in blocks((text.as_py() or b"").decode("utf-8", "replace")):
                    ids = v.encode(part)
                    told.update((" " * (n > 0 and len(ids) > 0) + " ".join(map(text_of, ids))).encode())
                    back.update(v.decode(ids))
                    n += len(ids)
                    if keep_ids:
                        held += ids
                count.append(n)
                coded.append(told.hexdigest())
                decoded.append(back.hexdigest())
                kept.append(held)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(coded), pa.array(decoded)]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = picked.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
