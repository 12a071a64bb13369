"""Cutting oversized texts at natural boundaries (problem 6).

A text begins as atoms (sentences and lines; words where those are too long;
parts of a word where even that is too long).  Neighbouring atoms wait in a heap
by the strength of the boundary between them, then by their joint size, and the
weakest boundaries are merged first while the joint size plus the overlap fits.
What is left are the pieces: each covers [start, end) of the text, and its text
starts ``overlap`` characters earlier, where there are any.

Texts within the limit never leave the JVM.  Only the text's own row is cut, so
pieces never mix paragraphs or chapters, and the covered ranges are a partition
of the text.

Defined results: null text gives no piece, an empty text one empty piece; sizes
are Unicode code points; repeated rows are cut again; an empty table gives an
empty result; other columns pass through, and a column named like a result
(piece, pieces, start, end, overlap, piece_text) is replaced.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CutRule:
    """Largest piece, overlap included, and the overlap, in characters."""

    limit: int = 1400
    overlap: int = 100

    def __post_init__(self) -> None:
        if self.limit < 2 or not 0 <= self.overlap < self.limit:
            raise ValueError("need 0 <= overlap < limit")


PART, WORD, CLAUSE, SENTENCE, LINE, BLANK_LINE = range(6)
_SENTENCES = re.compile(r".*?(?:[.!?…।؟]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*|\n\s*|$)", re.S)
_WORDS = re.compile(r"\s*\S+\s*|\s+")
_LINE_END = re.compile(r"\n[^\S\n]*$|\n")


def strength(text: str) -> int:
    """How strong the boundary after this stretch of text is."""
    body = text.rstrip()
    tail = text[len(body) :]
    if tail.count("\n") > 1:
        return BLANK_LINE
    if "\n" in tail:
        return LINE
    if re.search(r"[.!?…।؟][\"'”’»)\]]*$", body) and tail or re.search(r"[。！？][”’」』）]*$", body):
        return SENTENCE
    if re.search(r"[,;:،、，；：—–][\"'”’»)\]]*$", body):
        return CLAUSE
    return WORD if tail else PART


def atoms(text: str, room: int) -> list[int]:
    """Ends of the atoms of a text, none longer than ``room``."""
    ends: list[int] = []
    for m in _SENTENCES.finditer(text):
        s, e = m.span()
        if s == e:
            continue
        if e - s <= room:
            ends.append(e)
            continue
        for w in _WORDS.finditer(text, s, e):
            a, b = w.span()
            while b - a > room:
                cut = a + room
                while cut > a + 1 and unicodedata.combining(text[cut]):
                    cut -= 1
                if cut == a + 1:
                    cut = a + room
                ends.append(cut)
                a = cut
            if b > a:
                ends.append(b)
    return ends


def cut(text: str, rule: CutRule) -> list[tuple[int, int]]:
    """The covered ranges of a text's pieces, in order."""
    n = len(text)
    if n <= rule.limit:
        return [(0, n)]
    room = rule.limit - rule.overlap
    ends = atoms(text, room)
    starts = [0, *ends[:-1]]
    k = len(ends)
    left, right = list(range(-1, k - 1)), [*range(1, k), -1]
    alive = [True] * k
    power = [strength(text[s:e]) for s, e in zip(starts, ends)]
    heap = [(power[i], ends[i + 1] - starts[i], i, i + 1) for i in range(k - 1) if ends[i + 1] - starts[i] <= room]
    heapq.heapify(heap)
    while heap:
        p, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or ends[j] - starts[i] != size:
            continue
        alive[j] = False
        ends[i], power[i] = ends[j], power[j]
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and ends[b] - starts[a] <= room:
                heapq.heappush(heap, (power[a], ends[b] - starts[a], a, b))
    return [(starts[i], ends[i]) for i in range(k) if alive[i]]


def split_items(df: DataFrame, text: str = "text", rule: CutRule = CutRule()) -> DataFrame:
    """One row per piece: the row's other columns, piece (from 1), pieces, start, end, overlap, piece_text."""
    made = {"piece", "pieces", "start", "end", "overlap", "piece_text"}
    rest = [c for c in df.columns if c != text and c not in made]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.where(F.col(text).isNotNull()).select(*rest, F.col(text).alias("_text"))
    size = F.length("_text")
    one, zero = F.lit(1), F.lit(0)
    small = rows.where(size <= rule.limit).select(*rest, one.alias("piece"), one.alias("pieces"), zero.alias("start"), size.alias("end"), zero.alias("overlap"), F.col("_text").alias("piece_text"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "piece int, pieces int, start int, end int, overlap int, piece_text string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, num, of, s0, e0, ov, out = [], [], [], [], [], [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                spans = cut(t, rule)
                for j, (s, e) in enumerate(spans, 1):
                    o = min(rule.overlap, s)
                    src.append(i), num.append(j), of.append(len(spans)), s0.append(s), e0.append(e), ov.append(o), out.append(t[s - o : e])
            take = pa.array(src, pa.int64())
            cols = [b.column(c).take(take) for c in rest] + [pa.array(x, pa.int32()) for x in (num, of, s0, e0, ov)] + [pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, "piece", "pieces", "start", "end", "overlap", "piece_text"])

    large = rows.where(size > rule.limit).mapInArrow(work, schema)
    return small.unionByName(large)
