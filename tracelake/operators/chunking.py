"""Document chunking: sections, paragraphs, sentences, and packing of them into chunks.

Sections, paragraphs and sentences are JVM expressions. Chunks are found from sizes alone: the pieces of a text are measured
once, prefix sums tell how many of them fit together, and texts are only joined for the groups that result. That runs in
Arrow batches, row-local: one document in, its chunks out.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank, strip

# Sizes and labels of the chunker.
MAX_CHARS, MIN_CHARS, MAX_CHUNKS = 3000, 200, 20
PREFACE, BODY = "(前言)", "(正文)"
CHUNKS = "key string, chunk_index int, section_title string, text string, char_count int"
JOINT = "\n\n"

#: A heading line: its title is the group. ``\n`` alone ends a line.
HEADING = r"#{1,6}[ \t\x0B\f\r]+(.+)"
_HEADINGS = re.compile(rf"^{HEADING}$", re.M)
_BLANK_LINES = re.compile(r"\n\s*\n")
_SENTENCE_ENDS = re.compile(r"(?<=[。！？.!?])\s*")

Chunk = tuple[str, str]


def paragraphs(c: Column) -> Column:
    """Non-blank paragraphs, stripped."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), lambda p: non_blank(p)), lambda p: p.isNotNull())


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[。！？.!?])\s*"), lambda s: non_blank(s)), lambda s: s.isNotNull())


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, section_title, body): text under each heading line; sections without lines are left out.

    A text is split before its heading lines, so nothing is shuffled and the work is linear in its length.
    """
    pieces = F.split(F.col(text), rf"(?dm)^(?={HEADING})", -1)
    start = rf"(?d)^{HEADING}"

    def section(piece: Column, i: Column) -> Column:
        held = F.when(i < F.size(pieces) - 1, F.substring(piece, F.lit(1), F.length(piece) - 1)).otherwise(piece)  # without the line end before the next heading
        lead = F.instr(held, "\n")
        below = F.when(lead > 0, F.substring(held, lead + 1, F.length(held)))
        titled = piece.rlike(start)
        return F.struct(F.when(titled, strip(F.regexp_extract(piece, start, 1))).otherwise(PREFACE).alias("title"), F.when(titled, below).otherwise(held).alias("body"))

    found = F.filter(F.transform(pieces, section), lambda s: s["body"].isNotNull())
    out = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(found).alias("pos", "s"))
    return out.select("key", (F.col("pos") + 1).alias("section_no"), F.col("s.title").alias("section_title"), F.col("s.body").alias("body"))


def _titled_spans(text: str) -> Iterator[Chunk]:
    """(title, body) of every section that has lines, from the spans between heading lines."""
    marks = [(m.start(), m.end() + 1, m[1].strip()) for m in _HEADINGS.finditer(text)]
    edges = [(0, PREFACE), *((end, title) for _, end, title in marks)]
    stops = [start - 1 for start, _, _ in marks] + [len(text)]
    return ((title, text[a:b]) for (a, title), b in zip(edges, stops) if a <= b)


def _groups(sizes: list[int], joint: int, room: int) -> Iterator[slice]:
    """Neighbours that fit together, as many as possible from the left; a size over the room stands alone."""
    upto = np.cumsum(np.asarray(sizes, dtype=np.int64) + joint)
    i = 0
    while i < len(sizes):
        used = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, used + room, side="right")))
        yield slice(i, j)
        i = j


def _pieces(body: str, limit: int) -> list[str]:
    """A section's text in pieces: paragraphs that fit together; a paragraph over the limit by its sentences."""
    parts = [p.strip() for p in _BLANK_LINES.split(body)]
    out = []
    for long, run in groupby((p for p in parts if p), key=lambda p: len(p) > limit):
        if long:
            for p in run:
                said = [s.strip() for s in _SENTENCE_ENDS.split(p) if s.strip()]
                out += [" ".join(said[g]) for g in _groups([len(s) for s in said], 1, limit)]
        else:
            run = list(run)
            out += [JOINT.join(run[g]) for g in _groups([len(p) for p in run], len(JOINT), limit + len(JOINT))]
    return out


def merge_small(chunks: list[Chunk], least: int = MIN_CHARS) -> list[Chunk]:
    """Chunks of one section, joined until each has the least size; what is left at the end of the document joins the one before."""
    out: list[Chunk] = []
    for title, run in groupby(chunks, key=lambda c: c[0]):
        texts = [t for _, t in run]
        upto = np.cumsum([len(t) + len(JOINT) for t in texts])
        i = 0
        while i < len(texts):
            enough = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + least + len(JOINT), side="left")) + 1
            out.append((title, JOINT.join(texts[i:enough])))
            i = enough
    if len(out) > 1 and len(out[-1][1]) < least and out[-2][0] == out[-1][0]:
        out[-2:] = [(out[-2][0], out[-2][1] + JOINT + out[-1][1])]
    return out


def at_most(chunks: list[Chunk], most: int) -> list[Chunk]:
    """No more than ``most`` chunks: the smallest joins its right neighbour, the last its left one, until that holds.

    A heap of sizes over a linked list, so a document of n chunks takes n log n steps.
    """
    n = len(chunks)
    size, after, before = [len(t) for _, t in chunks], list(range(1, n + 1)), list(range(-1, n - 1))
    tail = list(range(n))  # the last chunk that each head has taken in
    gone = [False] * n
    heap = [(s, k) for k, s in enumerate(size)]
    heapq.heapify(heap)
    left = n
    while left > most and left > 1:
        s, k = heapq.heappop(heap)
        if gone[k] or s != size[k]:
            continue  # an older size
        if after[k] == n:
            k = before[k]
        other = after[k]
        size[k] += len(JOINT) + size[other]
        after[k], tail[k], gone[other] = after[other], tail[other], True
        if after[k] < n:
            before[after[k]] = k
        heapq.heappush(heap, (size[k], k))
        left -= 1
    return [(chunks[k][0], JOINT.join(t for _, t in chunks[k : tail[k] + 1])) for k in range(n) if not gone[k]]


def chunk_text(text: str, limit: int = MAX_CHARS, most: int = MAX_CHUNKS) -> list[Chunk]:
    """(section title, text) of every chunk of one document."""
    parts = list(_titled_spans(text))
    if [title for title, _ in parts] == [PREFACE]:
        parts = [(BODY, text)]
    return at_most(merge_small([(title, piece) for title, body in parts for piece in ([body.strip()] if title != BODY and 0 < len(body.strip()) <= limit else _pieces(body, limit))]), most)


def chunk_documents(docs: DataFrame, key: str, text: str, limit: int = MAX_CHARS, most: int = MAX_CHUNKS) -> DataFrame:
    """(key, chunk_index, section_title, text, char_count). NULL and blank documents have no chunks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, i, title, body, len(body)) for k, t in zip(part["key"], part["text"]) for i, (title, body) in enumerate(chunk_text(t, limit, most))]
            yield pd.DataFrame(rows, columns=["key", "chunk_index", "section_title", "text", "char_count"])

    return docs.where(non_blank(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, CHUNKS)


def strategy(length: Column, n_sections: Column) -> Column:
    """How much effort a document deserves, by length and structure."""
    return F.when(length < 3000, "fast").when((length < 15000) & (n_sections <= 3), "fast").when(length <= 50000, "balanced").otherwise("deep")
