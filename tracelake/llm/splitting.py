"""Splitting oversized items at natural boundaries.

Method. All natural boundaries of a text are found in one pass, each with a cut penalty: paragraph 0, line 1, sentence 2, clause
4, space 6; positions between two characters of a word (12) are only offered where no other boundary lies within a
window, so that a way always exists. Dynamic programming over the boundary positions minimises the sum of the cut penalties and of the
squared deviations of the piece sizes from an even share, subject to the maximum size and the overlap: every piece
but the first starts exactly ``overlap`` characters before the end of the piece before it.

Scale. Row-local: no shuffle. Only items over the limit reach Python. A text of n characters has at most n boundaries
and each looks back over one window, which is done in vectors; the memory is proportional to the text.

Defined results. Sizes are code points. Items within the limit, empty and NULL texts give no rows from ``pieces`` (``split_all``
passes them on whole). An overlap of at least the limit is an error. Pieces joined without their overlaps give the text
back. Ties go to the later boundary. Repeated rows are split each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "item_key string, piece_no int, n_pieces int, start bigint, size bigint, cut string, piece string"

# Kinds of boundaries, their penalties, and the characters that make them.
KINDS = ["end", "paragraph", "line", "sentence", "clause", "space", "hard"]
PENALTY = np.array([0.0, 0.0, 1.0, 2.0, 4.0, 6.0, 12.0])
FULL_STOPS, STOPS_BEFORE_SPACE, CLAUSE_MARKS, CLOSERS, QUOTES = "。！？…", ".!?", "，、；：,;:", "”’」』）】)]", "\"'"
IMBALANCE = 40.0


def _table() -> np.ndarray:
    """Bits of every character of the basic plane: 1 blank, 2 line end, 4 stop, 8 stop before white space, 16 clause, 32 closer, 64 quote."""
    bits = np.zeros(0x10000, dtype=np.uint8)
    bits[[p for p in range(0x3001) if chr(p).isspace() and chr(p) not in "\r\n"]] = 1
    for bit, chars in ((2, "\r\n"), (4, FULL_STOPS), (8, STOPS_BEFORE_SPACE), (16, CLAUSE_MARKS), (32, CLOSERS), (64, QUOTES)):
        bits[[ord(c) for c in chars]] |= bit
    return bits


_BITS = _table()


def _past(mask: np.ndarray) -> np.ndarray:
    """For every position (one more than the text has) the first position from there on that the mask doesn't cover."""
    at = np.where(mask, len(mask), np.arange(len(mask)))
    return np.minimum.accumulate(np.append(at, len(mask))[::-1])[::-1]


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions (0 < p < length) and kinds of all natural boundaries, each position with its best kind.

    A cut comes after blanks; after a clause mark or a stop with its closing marks and blanks; after a line end; and after
    several line ends with nothing but blanks between them. All are found in vectors over the code points.
    """
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bits = np.where(points < 0x10000, _BITS[np.minimum(points, 0xFFFF)], 0).astype(np.uint8)
    kind = np.zeros(n + 1, dtype=np.int8)
    blank, line = (bits & 1) > 0, (bits & 2) > 0
    past_blank = _past(blank)
    kind[np.flatnonzero(blank[:-1] & ~blank[1:]) + 1] = 5
    clause = np.flatnonzero(bits & 16)
    kind[past_blank[_past((bits & 32) > 0)[clause + 1]]] = 4
    spaced = np.append(blank | line, True)
    stop = np.flatnonzero(((bits & 4) > 0) | (((bits & 8) > 0) & spaced[1:]))
    kind[past_blank[_past((bits & 96) > 0)[stop + 1]]] = 3
    broken = np.append((points[:-1] == 13) & (points[1:] == 10), False) if n else line
    ends = np.flatnonzero(line & ~broken) + 1  # positions after a line end; \r\n is one
    if len(ends):
        kind[ends] = 2
        starts = ends - 1 - ((ends >= 2) & broken[np.maximum(ends - 2, 0)])
        follows = np.append(starts[1:] == past_blank[ends[:-1]], False)  # only blanks before the next line end
        after = np.append(False, follows[:-1])
        kind[ends[after & ~follows]] = 1
    kind[[0, -1]] = 0
    where = np.flatnonzero(kind)
    return where, kind[where]


def cuts(text: str, limit: int, overlap: int) -> tuple[list[int], list[int]]:
    """End positions of the pieces and the kinds of the cuts (the last is the end of the text)."""
    n = len(text)
    if n <= limit:
        return [n], [0]
    pos, kind = boundaries(text)
    step = limit - overlap
    edges = np.concatenate([[0], pos, [n]])
    gaps = np.flatnonzero(np.diff(edges) > max(1, step // 2))
    if len(gaps):  # stretches without a boundary get hard ones, so that every window holds some
        extra = np.concatenate([np.arange(edges[g] + max(1, step // 4), edges[g + 1], max(1, step // 4)) for g in gaps])
        pos, kind = np.concatenate([pos, extra]), np.concatenate([kind, np.full(len(extra), 6, dtype=np.int8)])
        order = np.argsort(pos, kind="stable")
        pos, kind = pos[order], kind[order]
    pos, kind = np.concatenate([pos, [n]]), np.concatenate([kind, [0]])
    k = -(-(n - overlap) // step)
    ideal = (n + (k - 1) * overlap) / k
    scale = IMBALANCE**0.5 / limit
    here = pos * scale
    there = (pos - overlap + ideal) * scale  # here[i] - there[j]: what the piece from j to i deviates by
    penalty = PENALTY[kind]
    cost = np.where(pos <= limit, (here - ideal * scale) ** 2 + penalty, np.inf)
    back = np.where(pos <= limit, -1, -2)
    onward = np.where(pos > overlap, cost, np.inf)  # a next piece may not start before the text does
    low = np.searchsorted(pos, pos - step, side="left").tolist()
    for i in range(1, len(pos)):
        j0 = low[i]
        if j0 < i:
            ways = here[i] - there[j0:i]
            ways *= ways
            ways += onward[j0:i]
            j = i - 1 - int(ways[::-1].argmin())
            total = ways[j - j0] + penalty[i]
            if total < cost[i]:
                cost[i], back[i] = total, j
                if pos[i] > overlap:
                    onward[i] = total
    if not np.isfinite(cost[-1]):  # an overlap so near the limit that the boundaries offered leave no way: even cuts
        ends = [min(n, limit + s * step) for s in range(k)]
        return ends, [6] * (len(ends) - 1) + [0]
    ends, kinds, i = [], [], len(pos) - 1
    while i >= 0:
        ends.append(int(pos[i]))
        kinds.append(int(kind[i]))
        i = back[i]
    return ends[::-1], kinds[::-1]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of every piece."""
    if overlap >= limit:
        raise ValueError(f"an overlap of {overlap} leaves no room in {limit}")
    ends, kinds = cuts(text, limit, overlap)
    starts = [0] + [e - overlap for e in ends[:-1]]
    return [(s, e, KINDS[k]) for s, e, k in zip(starts, ends, kinds)]


def pieces(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(item_key, text) -> the pieces of every item over the limit."""
    if overlap >= limit:
        raise ValueError(f"an overlap of {overlap} leaves no room in {limit}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, text in zip(part["item_key"], part["text"]):
                cut = split_text(text, limit, overlap)
                rows += [(key, i + 1, len(cut), s, e - s, kind, text[s:e]) for i, (s, e, kind) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=["item_key", "piece_no", "n_pieces", "start", "size", "cut", "piece"])

    over = items.where(F.length("text") > limit).select(F.col("item_key").cast("string").alias("item_key"), "text")
    return over.mapInPandas(run, PIECES)


def split_all(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of the items over the limit, and all other items as their one piece."""
    fits = items.where(F.coalesce(F.length("text"), F.lit(0)) <= limit)
    whole = fits.select(F.col("item_key").cast("string").alias("item_key"), F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("bigint").alias("start"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"), F.lit("end").alias("cut"), F.col("text").alias("piece"))
    return pieces(items, limit, overlap).unionByName(whole)
