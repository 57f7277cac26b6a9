"""String similarity on a 0-100 scale, from longest matching blocks."""
from __future__ import annotations

import difflib
import functools
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


#: From this length on, difflib leaves frequent characters out; those strings are its own.
_LONG = 200


def _blocks(a: str, b: str, i: int = 0, j: int = 0) -> list[tuple[int, int, int]]:
    """difflib's matching blocks of short strings, found by substring search.

    The longest common piece, of equal ones the first in ``a`` and then in ``b``; then
    the same on both sides of it.
    """
    at = size = 0
    for k in range(len(a)):
        while k + size < len(a) and a[k:k + size + 1] in b:
            at, size = k, size + 1
        if k + size >= len(a):
            break
    if not size:
        return []
    to = b.find(a[at:at + size])
    return [*_blocks(a[:at], b[:to], i, j), (i + at, j + to, size),
            *_blocks(a[at + size:], b[to + size:], i + at + size, j + to + size)]


def _share(a: str, b: str) -> float:
    """difflib's ratio of two strings that are not empty."""
    if len(b) >= _LONG:
        return difflib.SequenceMatcher(None, a, b).ratio()
    return 2.0 * sum(size for _, _, size in _blocks(a, b)) / (len(a) + len(b))


@functools.lru_cache(1 << 15)
def ratio(a: str, b: str) -> int:
    """Twice the matched characters over all characters; equal strings are alike, empty ones too."""
    if a == b:
        return 100
    if not a or not b:
        return 0
    return round(100 * _share(a, b))


def reaches(a: str, b: str, least: int) -> bool:
    """``ratio(a, b) >= least``, ruled out by cheap upper bounds where possible."""
    if a == b:
        return True
    if not a or not b:
        return False
    match, floor = difflib.SequenceMatcher(None, a, b), (least - 0.5) / 100
    if match.real_quick_ratio() < floor or match.quick_ratio() < floor:
        return False
    return round(100 * match.ratio()) >= least


def partial_reaches(a: str, b: str, least: int) -> bool:
    """``partial_ratio(a, b) >= least`` with the same short cuts.

    No piece can share more characters with the shorter string than the whole
    longer string does, and a piece at the end may be as short as what it shares.
    """
    if a == b:
        return True
    if not a or not b:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return True
    shared = sum((Counter(short) & Counter(long)).values())
    if 2 * shared / (len(short) + shared) < (least - 0.5) / 100:
        return False
    return partial_ratio(a, b) >= least


def partial_ratio(a: str, b: str) -> int:
    """Best ratio of the shorter string against an equally long piece of the other."""
    if a == b:
        return 100
    if not a or not b:
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100
    best = 0.0
    if len(long) < _LONG:
        blocks = [*_blocks(short, long), (len(short), len(long), 0)]
    else:
        blocks = difflib.SequenceMatcher(None, short, long).get_matching_blocks()
    for begin in dict.fromkeys(max(0, block[1] - block[0]) for block in blocks):
        best = max(best, _share(short, long[begin:begin + len(short)]))
        if best > 0.995:
            return 100
    return round(100 * best)


def _words(text: str) -> set[str]:
    low = text.lower()
    return {low} if low.isalnum() else set("".join(c if c.isalnum() else " " for c in low).split())


def token_set_ratio(a: str, b: str) -> int:
    """Best ratio among the shared words and each side's shared plus own words."""
    left, right = _words(a), _words(b)
    if not left or not right:
        return 0
    shared = " ".join(sorted(left & right))
    one = f"{shared} {' '.join(sorted(left - right))}".strip()
    two = f"{shared} {' '.join(sorted(right - left))}".strip()
    return max(ratio(shared, one), ratio(shared, two), ratio(one, two))


def _pairwise(score):
    @F.pandas_udf(IntegerType())
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = None if None in pair else score(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="Int32")
    return column


ratio_udf = _pairwise(ratio)
partial_ratio_udf = _pairwise(partial_ratio)
token_set_ratio_udf = _pairwise(token_set_ratio)
