"""Evaluation passages inside training text: greedy string tiling (problem 8).

One pass over the corpus, whatever the number of passages.  Every text is
normalised on its own (entities, JSON escapes, markup, invisible characters,
compatibility forms, case, words split at line ends), its words are hashed to 64
bits, and running Karp-Rabin hashes of eight words (the seeds) are taken of the
flat array of a batch's words; document borders are offsets into that array.

The passages' seeds make a bit filter of bounded size, which is broadcast; only
documents with a seed in it go on, each as the stretches of words that those
seeds cover.  Their seeds are joined with the passages' seeds, pairs that could
reach the wanted coverage meet the words of both sides, and greedy tiling runs on
them: the longest run of words common to both sides is looked for by its
Karp-Rabin hash, all places where it fits without overlap are marked, and the
search goes on among what is left until no run of eight words is.  No pair of
equal seeds is ever written out, so repeated words cost no more than others.

A pair is reported if its tiles hold half of the passage's words or more, in
whatever order.  The filter lets some foreign seeds through, never keeps one
back; the join drops them.

Defined results: null or empty documents and passages leak nothing, nor do rows
with a null id; passages of fewer than eight words cannot leak; rows that share
document id and item id come out once, with the largest coverage; of equally long
common runs those earlier in the document are marked first; texts count whole,
however long; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barkeel.session import durable


@dataclass(frozen=True)
class LeakRule:
    """Words in a row that count, share of a passage that makes a leak, most bits of the seed filter (as a power of 2)."""

    run: int = 8
    share: float = 0.5
    filter_bits: int = 29


_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrt\"/])")
_TAG = re.compile(r"</?[A-Za-z][\w:-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>]++))?)*+\s*+/?>|<!(?!--)[^<>]*+>")
_LINK = re.compile(r"(?<=\])\((?:https?:|/|#|mailto:)[^()\s]*+\)")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_SOFT_SPLIT = re.compile("\u00ad[ \\t]*\\r?\\n[ \\t]*")
_SPLIT = re.compile("[-\u2010\u2011][ \\t]*\\r?\\n[ \\t>]*(?=\\w)")
_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x100000001B3)
_PROBES = 4


def _unescaped(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else {"n": "\n", "r": "\n", "t": "\t"}.get(m[2], m[2])


def _without_comments(text: str) -> str:
    kept, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        kept.append(text[at:start])
        at = end + 3
    return " ".join([*kept, text[at:]])


def normalise(text: str) -> str:
    """Text without what makes no difference."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(_unescaped, text)
        if not text.isascii():  # two escapes may be the halves of one character
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", _SOFT_SPLIT.sub("", text)))
    if "<" in text:
        text = _TAG.sub(" ", _without_comments(text))
    if "](" in text:
        text = _LINK.sub(" ", text)
    return (_SPLIT.sub("", text) if "\n" in text else text).casefold()


class _Hashes(dict):
    """Word to 64-bit hash (never 0), remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) or 1
        self[word] = h
        return h


_HASHES = _Hashes()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts in one array, and the offsets of the texts in it."""
    tokens = [_TOKEN.findall(normalise(t)) for t in texts]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in tokens], out=offsets[1:])
    look = _HASHES.__getitem__
    return np.fromiter((look(w) for t in tokens for w in t), dtype=np.uint64, count=int(offsets[-1])), offsets


def rolling(words: np.ndarray, run: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all runs of ``run`` words of an array.

    A run of any length is put together from runs whose lengths are powers of two.
    """
    n = len(words) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done = None, 0
    power, length, weight = words, 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if run & length:
                part = power[done : done + n]
                out = part if out is None else out * weight + part
                done += length
            if length * 2 > run:
                return out
            power = power[:-length] * weight + power[length:]
            weight, length = weight * weight, length * 2


def spread(seeds: np.ndarray) -> np.ndarray:
    """Seeds mixed so that each stretch of bits is good for a filter probe."""
    with np.errstate(over="ignore"):
        x = (seeds ^ (seeds >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def tile(doc: np.ndarray, item: np.ndarray, run: int) -> int:
    """Words of ``item`` under greedy tiles; a 0 in ``doc`` is a gap.

    Marked words are cut out of both sides by marks of their own, so that no later
    run goes through them.  The length of the longest common run never grows, and
    a length has a common run only if all shorter ones have, so it is found by
    halving; hashes are confirmed by the words.
    """
    a, b = doc.copy(), item.copy()
    free_a, free_b = a != 0, np.ones(len(b), dtype=bool)

    def starts(free: np.ndarray, length: int) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[length:] == taken[:-length]) if len(free) >= length else np.zeros(0, dtype=np.int64)

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        sa, sb = starts(free_a, length), starts(free_b, length)
        if not len(sa) or not len(sb):
            return None
        ha, hb = rolling(a, length)[sa], rolling(b, length)[sb]
        keep_a, keep_b = np.isin(ha, hb), np.isin(hb, ha)
        return (sa[keep_a], ha[keep_a], sb[keep_b], hb[keep_b]) if keep_a.any() else None

    most = len(b)
    while True:
        low, high, best = run, most, common(run)
        if best is None:
            return int((~free_b).sum())
        while low < high:
            middle = (low + high + 1) // 2
            got = common(middle)
            if got is None:
                high = middle - 1
            else:
                low, best = middle, got
        sa, ha, sb, hb = best
        places: dict[int, list[int]] = {}
        for at, h in zip(sb[::-1].tolist(), hb[::-1].tolist()):
            places.setdefault(h, []).append(at)  # the earliest place is taken first
        marked = False
        for at, h in zip(sa.tolist(), ha.tolist()):
            if not free_a[at : at + low].all():
                continue
            stack = places[h]
            while stack and not free_b[stack[-1] : stack[-1] + low].all():
                stack.pop()
            if stack and np.array_equal(a[at : at + low], b[stack[-1] : stack[-1] + low]):
                free_a[at : at + low] = False
                free_b[stack[-1] : stack[-1] + low] = False
                marked = True
        if not marked:  # equal hashes of different words: such a length is passed over
            low -= 1
        most = low
        if most < run:
            return int((~free_b).sum())


_SIDE = "{key} {kind}, hash bigint, words array<bigint>, seeds array<bigint>"


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([*values, np.zeros(0, dtype=np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _rows(b: pa.RecordBatch, key: str, at: list[int], texts: list[str], words: list, seeds: list) -> pa.RecordBatch:
    digests = np.array([xxhash.xxh3_64_intdigest(texts[i].encode("utf-8", "surrogatepass")) for i in at], dtype=np.uint64)
    return pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), pa.array(digests.view(np.int64)), _lists(words), _lists(seeds)], names=[key, "hash", "words", "seeds"])


def item_side(items: DataFrame, rule: LeakRule) -> DataFrame:
    """item_id, hash of the passage, its words and its seeds, of passages that are long enough to leak."""
    kind, run = items.schema["item_id"].dataType.simpleString(), rule.run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            words, offsets = word_hashes(texts)
            long = [i for i in range(len(texts)) if offsets[i + 1] - offsets[i] >= run]
            own = [words[offsets[i] : offsets[i + 1]] for i in long]
            yield _rows(b, "item_id", long, texts, own, [rolling(w, run) for w in own])

    rows = items.where(F.col("passage").isNotNull() & F.col("item_id").isNotNull()).select("item_id", F.col("passage").cast("string").alias("text"))
    return rows.mapInArrow(work, _SIDE.format(key="item_id", kind=kind))


def seed_filter(sides: DataFrame, rule: LeakRule) -> tuple[np.ndarray, int]:
    """A bit filter of all seeds, 64 bits a seed up to ``filter_bits``, and its size as a power of two."""
    seeds = sides.select(F.explode("seeds").alias("seed")).distinct()
    count = seeds.count()
    bits = min(rule.filter_bits, max(16, int(64 * count).bit_length()))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = spread(b.column("seed").to_numpy(zero_copy_only=False).view(np.uint64))
            at = np.concatenate([_probe(x, k, bits) for k in range(_PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["at", "bits"])

    words = seeds.mapInArrow(probes, "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**(filter_bits - 6) rows
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table, bits


def _probe(x: np.ndarray, k: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        turned = (x << np.uint64(16 * k)) | (x >> np.uint64((64 - 16 * k) % 64)) if k else x
        return ((turned * np.uint64(2 * k + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def passes(seeds: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Places of the seeds that the filter lets through."""
    at, x = np.arange(len(seeds)), spread(seeds)
    for k in range(_PROBES):
        p = _probe(x, k, bits)
        on = (table[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        at, x = at[on], x[on]
    return at


def doc_side(docs: DataFrame, shared, bits: int, rule: LeakRule) -> DataFrame:
    """doc_id, hash of the text, words under its seeds in the filter (0 between stretches) and these seeds, of documents with any."""
    kind, run = docs.schema["doc_id"].dataType.simpleString(), rule.run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            words, offsets = word_hashes(texts)
            seeds = rolling(words, run)
            hit = passes(seeds, table, bits) if len(seeds) else np.zeros(0, dtype=np.int64)
            owner = np.searchsorted(offsets, hit, side="right") - 1
            inside = hit + run <= offsets[owner + 1]  # a run that reaches into the next text is none
            hit, owner = hit[inside], owner[inside]
            at, covered, found = [], [], []
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for group in np.split(hit, cuts) if len(hit) else []:
                last = np.flatnonzero(np.diff(group) > run) + 1  # stretches that do not touch
                pieces = []
                for stretch in np.split(group, last):
                    pieces += [words[stretch[0] : stretch[-1] + run], np.zeros(1, dtype=np.uint64)]
                at.append(int(np.searchsorted(offsets, group[0], side="right") - 1))
                covered.append(np.concatenate(pieces))
                found.append(np.unique(seeds[group]))
            yield _rows(b, "doc_id", at, texts, covered, found)

    rows = docs.where((F.length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, _SIDE.format(key="doc_id", kind=kind))


def _tiler(rule: LeakRule):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            covered, sizes = [], []
            sides = []
            for name in ("doc_words", "item_words"):
                column = b.column(name)
                sides.append((column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)))
            (da, dw), (ia, iw) = sides
            for i in range(b.num_rows):
                item = iw[ia[i] : ia[i + 1]]
                sizes.append(len(item))
                covered.append(tile(dw[da[i] : da[i + 1]], item, rule.run))
            keep = np.flatnonzero(np.array(covered) >= rule.share * np.array(sizes)) if sizes else np.zeros(0, dtype=np.int64)
            out = [b.column("doc_id"), b.column("item_id"), pa.array(covered, pa.int32()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in out], names=["doc_id", "item_id", "covered_words", "passage_words"])

    return work


def find_leaks(docs: DataFrame, items: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """doc_id, item_id, covered_words, passage_words, coverage of every leak."""
    spark = docs.sparkSession
    tests = durable(item_side(items, rule).dropDuplicates(["item_id", "hash"]))
    table, bits = seed_filter(tests, rule)
    shared = spark.sparkContext.broadcast(table)  # 2**(filter_bits - 3) bytes at most
    read = durable(doc_side(docs, shared, bits, rule))
    uses = tests.select("item_id", F.col("hash").alias("item_hash"), F.size("words").alias("n"), F.explode("seeds").alias("seed"))
    uses = uses.groupBy("seed", "item_id", "item_hash", "n").agg(F.count(F.lit(1)).alias("uses"))
    hits = read.select("doc_id", F.col("hash").alias("doc_hash"), F.explode("seeds").alias("seed"))
    pairs = hits.join(uses, "seed").groupBy("doc_id", "doc_hash", "item_id", "item_hash", "n").agg(F.sum("uses").alias("uses"))
    pairs = pairs.where(F.col("uses") * rule.run >= rule.share * F.col("n")).drop("uses", "n")
    left = read.dropDuplicates(["doc_id", "hash"]).select("doc_id", F.col("hash").alias("doc_hash"), F.col("words").alias("doc_words"))
    right = tests.select("item_id", F.col("hash").alias("item_hash"), F.col("words").alias("item_words"))
    both = pairs.join(left, ["doc_id", "doc_hash"]).join(right, ["item_id", "item_hash"]).select("doc_id", "item_id", "doc_words", "item_words")
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    found = both.mapInArrow(_tiler(rule), f"doc_id {kinds[0]}, item_id {kinds[1]}, covered_words int, passage_words int")
    best = F.max(F.struct((F.col("covered_words") / F.col("passage_words")).alias("coverage"), "covered_words", "passage_words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.covered_words", "b.passage_words", "b.coverage")
