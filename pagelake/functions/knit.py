"""Knitting overlapping text segments."""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def knit_pair(a: str, b: str) -> str:
    """``a`` up to the longest substring it shares with ``b``, then ``b`` from there; both in full where they share none."""
    at, start, size = longest_shared(a, b)
    return a + b if size == 0 else a[:at] + b[start:]


#: Shared characters from which blocks are looked for, and hits of blocks up to which they are followed.
LEAST, HITS = 16, 200


def _known(a: str, b: str) -> int:
    """Length of one match, or 0: where ``a`` last has the beginning of ``b``, as overlapping segments do."""
    at = a.rfind(b[:LEAST]) if len(b) >= LEAST else -1
    return 0 if at < 0 else _same(a[at : at + len(b)], b)


def _same(p: str, q: str) -> int:
    """Length of the common beginning."""
    return len(commonprefix((p, q)))


def _by_blocks(a: str, b: str, q: int) -> tuple[int, int, int] | None:
    """The longest match if it has 2 ``q`` - 1 characters at least, so that it holds one of the blocks of ``q`` that ``b`` is cut into.

    Every hit of a block is followed both ways; None if there are too many hits.
    """
    best, hits = (0, 0, 0), 0
    for i in range(0, len(b) - q + 1, q):
        block = b[i : i + q]
        at = a.find(block)
        while at >= 0:
            hits += 1
            if hits > HITS:
                return None
            right = _same(a[at + q : at + len(b) - i], b[i + q :])
            left = _same(a[max(0, at - i) : at][::-1], b[:i][::-1])
            best = min(best, (-left - q - right, at - left, i - left))
            at = a.find(block, at + 1)
    return best[1], best[2], -best[0]


def longest_shared(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of difflib's longest match, by substring searches: fast for a long ``a`` and a short ``b``."""
    known = _known(a, b)
    if known >= LEAST and (best := _by_blocks(a, b, (known + 1) // 2)):
        return best
    size, found = 0, []
    for i in range(len(b)):
        if i + size > len(b):
            break
        if b[i : i + size] not in a:
            continue
        found.append(i)
        while i + size < len(b) and b[i : i + size + 1] in a:
            size, found = size + 1, [i]
    return (*min((a.index(b[i : i + size]), i) for i in found), size) if size else (0, 0, 0)


def knit_all(parts) -> str:
    parts = [p or "" for p in (parts if parts is not None else [])]
    return reduce(knit_pair, parts) if parts else ""


def knit(parts: Column | str) -> Column:
    """Of each list of segments in order, one text. Groups are whole in a row, so batches hold whole groups."""

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(knit_all)

    return F.pandas_udf(run, StringType())(parts)
