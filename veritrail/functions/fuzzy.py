"""Fuzzy string scores (0 to 100) by indel distance, as pandas UDFs over Arrow batches.

ratio: 200 * longest common subsequence / total length. partial: the best ratio of the shorter string with a window of the
longer one of its length. weighted: the greatest of ratio, word-sorted and word-set ratios (times 0.95), and, where lengths
differ by half or more, partial ratios (times 0.9, or 0.6 beyond a factor of eight).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: str | list[int], b: str | list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel in the shorter sequence."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    at: dict[str | int, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = state = (1 << len(a)) - 1
    for c in b:
        u = state & at.get(c, 0)
        state = (state + u | state - u) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n = len(a)
    return max(ratio(a, b[max(0, k) : k + n]) for k in range(1 - n, len(b)))


def reaches(a: str, b: str, least: float = 95.0) -> bool:
    """Whether partial(a, b) >= least. The shorter string is cut in more pieces than there may be edits, so one piece of it
    occurs in the window as it is; only windows about such places are scored."""
    if len(a) > len(b):
        a, b = b, a
    if not a or a in b:
        return partial(a, b) >= least
    n = len(a)
    edits = int(2 * n * (1 - least / 100) + 1e-9)
    if edits >= n:
        return partial(a, b) >= least
    cuts = [n * k // (edits + 1) for k in range(edits + 2)]
    starts: set[int] = set()
    for low, high in zip(cuts, cuts[1:]):
        at = b.find(a[low:high])
        while at >= 0:
            starts.update(range(max(1 - n, at - low - edits), min(len(b), at - low + edits + 1)))
            at = b.find(a[low:high], at + 1)
    return any(ratio(a, b[max(0, k) : k + n]) >= least for k in starts)


def weighted(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    best, size = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    wa, wb = sorted(a.split()), sorted(b.split())
    sa, sb = set(wa), set(wb)
    both, left, right = " ".join(sorted(sa & sb)), " ".join(sorted(sa - sb)), " ".join(sorted(sb - sa))

    def words(score) -> float:
        plain = score(" ".join(wa), " ".join(wb))
        if not both:
            return plain
        one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
        return max(plain, score(both, one), score(both, two), score(one, two))

    if size < 1.5:
        return max(best, 0.95 * words(ratio))
    scale = 0.9 if size <= 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * words(partial))


def _over(score):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = None if None in pair else score(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return run


def weighted_score(a: Column, b: Column) -> Column:
    return _over(weighted)(F.lower(a), F.lower(b))


def partial_score(a: Column, b: Column) -> Column:
    return _over(partial)(a, b)


def partial_reaches(a: Column, b: Column, least: float = 95.0) -> Column:
    return _over(lambda x, y: float(reaches(x, y, least)))(a, b) == 1


def nfkc(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return run(text)


def rouge_l(candidate: Column, reference: Column) -> Column:
    """F-measure of the longest common subsequence of words."""

    def score(a: str, b: str) -> float:
        words: dict[str, int] = {}
        code = lambda s: [words.setdefault(w, len(words)) for w in s.split()]
        x, y = code(a), code(b)
        return 2.0 * common(x, y) / (len(x) + len(y)) if x and y else 0.0

    return _over(score)(F.lower(candidate), F.lower(reference))
