"""Template residue and error-page text (problem 10).

Every line and sentence of every document is a message.  Messages are masked
(numbers, identifiers and quoted stretches become wildcards) and counted over the
whole corpus; those that more than one document has, or that hold a cue word, go
down a prefix tree of fixed depth: word count, then the first words.  In a leaf,
messages that agree in most places form one template, whose differing places
become wildcards; cue words are never wildcards.  A message that only one document
has and that holds no cue can get no verdict by the rules below, so it stays out.

A template is judged once, by what the corpus says of it, and the verdict goes
back to all its messages and from them to the documents:

* seeded: a seed pattern fits the template, or the message where a wildcard took a
  word away.  The patterns are short and general and know no corpus.
* freed: a seeded template that people write in many wordings (many messages,
  many word places that vary, a long sentence) is prose about a notice, not a
  notice, and loses the verdict.
* associated: a template without a seed that stands in enough documents, nearly
  all of which hold seeded templates of several other kinds, is part of such
  pages (their links, incident numbers, apologies) and gets the verdict; so pages
  are found whose notice no pattern knows.

Ordinary records are searched directly for slots that were never filled, values
that never arrived, and filler: runs of words without any function word in which
the same words come again and again, as in mashed keys and pseudo-Latin.  What
stands in back quotes is quoted, not unfilled.

Leaves are split further by a hash once they are large, so a frequent beginning
does not gather in one task; equal templates of several splits are one template.

Defined results: null and empty texts are no cases; whole texts are searched;
rows that share an id are one document; rows with a null id are ignored; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barkeel.llm.lexicon import CUES, FUNCTION_WORDS, MASHED_KEYS, VERDICTS
from barkeel.session import durable
from barkeel.shards import sharded_map


@dataclass(frozen=True)
class TreeRule:
    """The tree (depth in words, share of equal words that joins a template, messages per leaf split) and the verdicts of its templates.

    A seeded template is freed from ``free_forms`` messages on, if it has ``free_words``
    words or more and at least ``free_share`` of them vary.  A template is associated
    from ``support`` documents on, if ``company`` of them hold another seeded template
    and these are of ``partners`` different kinds or more.
    """

    depth: int = 3
    alike: float = 0.6
    leaf: int = 1024
    free_forms: int = 8
    free_words: int = 10
    free_share: float = 0.25
    support: int = 4
    company: float = 0.9
    partners: int = 3


WILD = "<*>"

_SLOT = re.compile(
    r"\{\{\s*[\w .\-]+\s*\}\}"
    r"|\{%[^%{}\n]+%\}"
    r"|<%=?[^%<>\n]+%>"
    r"|[$#]\{\s*[\w. ]+\s*\}"
    r"|(?<![\w$#{])\{(?:[A-Za-z_]\w*|\d{1,2})\}(?!\})"
    r"|@@\w+@@"
    r"|%\(\w+\)[sdfr]"
    r"|%[A-Z][A-Z_]{2,}%"
    r"|(?<!\w)__[A-Z][A-Z_]*__(?!\w)"
    r"|\[\[\s*[\w ]+\s*\]\]"
    r"|<<\s*[\w ]+\s*>>"
    r"|\[[A-Z][A-Z_]{3,}\]"
    r"|\[(?:your|insert|enter|add)\b[^\[\]\n]+\]"
    r"|<(?:insert|your|enter|add)\s[^<>\n]+>"
    r"|\b(?:TODO|TBD|FIXME)(?:\([^()\n]*\)|\s?[:\-–—])"
    r"|\bXX [A-Z_ ]{3,} XX\b"
)
_SLOT_SIGNS = ("{", "<", "[", "@@", "%", "__", "TODO", "TBD", "FIXME", "XX ")
_QUOTED_CODE = re.compile(r"`[^`\n]*`")
_MISSING = re.compile(r"(?<![\w`'\"])(?:None|null|nan|NaN|undefined|N/A%N/A|\[object Object\])(?=R?(?![\w`'\"]))")
_MISSING_SIGNS = ("None", "null", "nan", "NaN", "undefined", "N/A%N/A", "[object Object]")
_SENTENCE = re.compile(r"(?<=[.!?…])[ \t]+")
_LINE_OR_SENTENCE = re.compile(r"\n+|(?<=[.!?…])[ \t]+")
_NOTE = re.compile(r"^(\[[^\[\]]*\]|\([^()]*\)|<!--.*?-->)[ \t]+(?=\S)")
_LEAD = re.compile(r"^(?:[-*•>]\s+|(?:q|a)\s*:\s+|\d+[.)]\s+|question \d+:\s+)+", re.I)
_QUOTE = re.compile(r"\"[^\"\n]*\"|(?<!\w)'[^'\n]*'(?!\w)")
_HEX = re.compile(r"(?<!\w)(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{4,}(?!\w)")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_NAME = re.compile(r"(?<!\w)[a-z]+(?:_[a-z]+)+(?!\w)")
_RECORD_VALUE = re.compile(r"(\"[^\"]*\"\s*:)\s*(\"[^\"]*\"|[^,{}\[\]]+)")
_DIGIT = re.compile(r"\d")
_FUNCTION = frozenset(FUNCTION_WORDS)
_WORD = re.compile(r"(?!\d+\b)[^\W_]{2,}")


@lru_cache(maxsize=1)
def _finder():
    """A function that yields the (start, end) of cues in a lower-case text: an automaton's, or an expression's without it."""
    try:
        import ahocorasick
    except ImportError:
        any_cue = re.compile("|".join(re.escape(c) for c in sorted(CUES, key=len, reverse=True)))
        return lambda low: (m.span() for m in any_cue.finditer(low))
    tree = ahocorasick.Automaton()
    for c in CUES:
        tree.add_word(c, len(c))
    tree.make_automaton()
    return lambda low: ((end + 1 - size, end + 1) for end, size in tree.iter(low))


def has_cue(low: str) -> bool:
    return next(iter(_finder()(low)), None) is not None


def unfilled(text: str) -> bool:
    """A slot that was never filled, or a sentence of values that never arrived."""
    slots = any(s in text for s in _SLOT_SIGNS)
    missing = any(s in text for s in _MISSING_SIGNS)
    if not (slots or missing):
        return False
    plain = _QUOTED_CODE.sub(" ", text) if "`" in text else text
    if slots and _SLOT.search(plain):
        return True
    return missing and any(len(_MISSING.findall(s)) > 1 for s in _LINE_OR_SENTENCE.split(plain))


def filler(line: list[str]) -> bool:
    """Whether sentences of one line are filler: no function word in them, and words that come again and again.

    One sentence has six such words or more, seven in ten of which at most are
    different; several in a row, which may begin alike, have 16 or more, and three
    in five at most are different.  A sentence of mashed keys may have four words.
    """
    run: list[str] = []
    for sentence in line:
        if not _FUNCTION.isdisjoint(sentence.split()):
            run = []
            continue
        words = _WORD.findall(sentence)
        run += words
        n, different = len(words), len(set(words))
        if n >= 6 and different <= 0.7 * n or len(run) >= 16 and len(set(run)) <= 0.6 * len(run):
            return True
        if n >= 4 and sum(w in MASHED_KEYS for w in words) >= 0.7 * n:
            return True
    return False


def mask(message: str) -> str:
    """A lower-case message with its variable parts as wildcards."""
    out = message.strip()
    if not out[:1].isalpha() or ":" in out:
        out = _LEAD.sub("", out)
    if out.startswith("{") and out.endswith("}"):  # a whole record: its keys are what is constant
        return " ".join(_RECORD_VALUE.sub(r"\1 " + WILD, out).split())
    if '"' in out or "'" in out:
        out = _QUOTE.sub(WILD, out)
    if _DIGIT.search(out):
        out = _NUMBER.sub(WILD, _HEX.sub(WILD, out))
    if "_" in out:
        out = _NAME.sub(WILD, out)
    return " ".join(out.split()) if "  " in out or not out.isascii() or "\t" in out else out


def messages(text: str) -> tuple[dict[str, bool], bool]:
    """The masked messages of a text, each once, with whether they hold a cue word; and whether the text holds filler.

    Messages are sentences and lines; a note in brackets at a sentence's beginning is a message of its own.
    """
    found: dict[str, bool] = {}
    typed = False
    for line in text.split("\n"):
        low = line.lower()
        sentences = _SENTENCE.split(low)
        typed = typed or filler(sentences)
        for part in sentences:
            part = part.strip()
            while part:
                note = _NOTE.match(part) if part[0] in "[(<" else None
                one, part = (note[1], part[note.end() :]) if note else (part, "")
                m = "..." if one in ("...", "…") else mask(one)
                if m and m not in found:
                    found[m] = m == "..." or has_cue(m) or (WILD in m and has_cue(one))
    return found, typed


@lru_cache(maxsize=1)
def _verdicts() -> list[tuple[str, re.Pattern]]:
    return [(kind, re.compile(p)) for kind, p in VERDICTS]


def classify(template: str) -> str | None:
    """The kind of residue whose seed pattern fits, or None."""
    for kind, pattern in _verdicts():
        if pattern.search(template):
            return kind
    return None


def constants(message: str) -> list[bool]:
    """Per word of a message, whether a cue touches it."""
    hit = bytearray(len(message) + 1)
    for s, e in _finder()(message):
        hit[s:e] = b"\1" * (e - s)
    out, at = [], 0
    for w in message.split(" "):
        out.append(any(hit[at : at + len(w)]))
        at += len(w) + 1
    return out


def mine(masked: list[str], rule: TreeRule) -> tuple[list[int], list[str], list[int]]:
    """Template number per message of one leaf, the templates, and how many of their word places vary; messages come in sorted order.

    All messages of a leaf have the same number of words, so templates are rows of a
    matrix of word numbers and a message is compared with all of them at once.
    """
    numbers: dict[str, int] = {}
    split = [m.split(" ") for m in masked]
    width = len(split[0]) if split else 0
    coded = np.array([[numbers.setdefault(w, len(numbers)) for w in ws] for ws in split], dtype=np.int64).reshape(len(split), width)
    held = np.array([constants(m) for m in masked], dtype=bool).reshape(len(split), width)
    rows, fixed = np.zeros((16, width), dtype=np.int64), np.zeros((16, width), dtype=bool)
    n, out = 0, []
    for i in range(len(split)):
        same = rows[:n] == coded[i]
        equal = same.sum(axis=1)
        barred = (~same & (fixed[:n] | held[i])).any(axis=1)
        equal = np.where(barred, -1, equal)
        best = int(equal.argmax()) if n else -1
        if n and equal[best] >= rule.alike * width:
            rows[best][~same[best]] = -1
        else:
            if n == len(rows):
                rows, fixed = np.concatenate([rows, np.zeros_like(rows)]), np.concatenate([fixed, np.zeros_like(fixed)])
            rows[n], fixed[n] = coded[i], held[i]
            best, n = n, n + 1
        out.append(best)
    first: dict[int, int] = {}
    for i, k in enumerate(out):
        first.setdefault(k, i)
    forms = [" ".join(WILD if c < 0 else w for c, w in zip(rows[k], split[first[k]])) for k in range(n)]
    return out, forms, (rows[:n] < 0).sum(axis=1).tolist()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, direct (a slot or filler), msgs (key, cue, masked) of every document with text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            direct, sizes, masked, cues = [], [0], [], []
            for t in b.column("text").to_pylist():
                found, typed = messages(t)
                direct.append(typed or unfilled(t))
                masked += found.keys()
                cues += found.values()
                sizes.append(len(masked))
            keys = np.fromiter((xxhash.xxh3_64_intdigest(m) for m in masked), dtype=np.uint64, count=len(masked)).view(np.int64)
            flat = pa.StructArray.from_arrays([pa.array(keys), pa.array(cues, pa.bool_()), pa.array(masked, pa.string())], names=["key", "cue", "masked"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(direct, pa.bool_()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], names=["doc_id", "direct", "msgs"])

    return rows.mapInArrow(work, f"doc_id {kind}, direct boolean, msgs array<struct<key:bigint,cue:boolean,masked:string>>")


def mined(scanned: DataFrame, rule: TreeRule = TreeRule()) -> DataFrame:
    """key, template, tid, varying, words, seed (kind or null) of all messages in the tree."""
    said = scanned.select(F.explode("msgs").alias("m"))
    counted = said.groupBy(F.col("m.key").alias("key")).agg(F.count(F.lit(1)).alias("docs"), F.bool_or("m.cue").alias("cue")).where("docs > 1 or cue").select("key")
    # written first, so that its size is known: while it is small, no message text is shuffled for the join
    inside = said.select("m.key", "m.masked").join(durable(counted), "key").dropDuplicates(["key"])
    ws = F.split("masked", " ")
    inside = durable(inside.withColumn("leaf", F.xxhash64(F.size(ws), F.slice(ws, 1, rule.depth))))
    sizes = inside.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rule.leaf)
    split = F.pmod(F.col("key"), F.ceil(F.coalesce("n", F.lit(1)) / rule.leaf))
    parted = inside.join(sizes, "leaf", "left").select("leaf", split.alias("split"), "key", "masked")

    def kernel(t: pa.Table, starts: np.ndarray) -> pa.Table:
        masked = t.column("masked").to_pylist()
        names, varying, seeds = [], [], []
        for s, e in zip(starts, [*starts[1:], t.num_rows]):
            of, forms, varies = mine(masked[s:e], rule)
            seed = [classify(f) for f in forms]
            for i, k in enumerate(of):
                names.append(forms[k]), varying.append(varies[k])
                seeds.append(seed[k] or (classify(masked[s + i]) if varies[k] else None))
        out = t.select(["key"]).append_column("template", pa.array(names, pa.string())).append_column("varying", pa.array(varying, pa.int32()))
        return out.append_column("seed", pa.array(seeds, pa.string()))

    found = sharded_map(parted, ["leaf", "split"], ["masked"], kernel, "key bigint, template string, varying int, seed string")
    return found.withColumns({"tid": F.xxhash64("template"), "words": F.size(F.split("template", " "))})


def freed(rule: TreeRule) -> F.Column:
    """Whether a template's own statistics say prose; over rows of templates with forms, words and varying."""
    return (F.col("forms") >= rule.free_forms) & (F.col("words") >= rule.free_words) & (F.col("varying") >= rule.free_share * F.col("words"))


def judged(scanned: DataFrame, rule: TreeRule = TreeRule()) -> tuple[DataFrame, DataFrame]:
    """Templates with their statistics and verdict (kind, seeded or associated), and (doc_id, tid, seed) of the messages said."""
    tree = durable(mined(scanned, rule))
    forms = tree.groupBy("tid").agg(F.count(F.lit(1)).alias("forms"), F.max("varying").alias("varying"), F.max("words").alias("words"), F.min("template").alias("template"))
    prose = forms.where(freed(rule)).select("tid", F.lit(True).alias("_prose"))
    by_key = durable(tree.select("key", "tid", "seed").join(prose, "tid", "left").select("key", "tid", F.when(F.col("_prose").isNull(), F.col("seed")).alias("seed")))
    pairs = scanned.select("doc_id", F.explode("msgs.key").alias("key")).join(by_key, "key").repartition("doc_id").groupBy("doc_id", "tid").agg(F.max("seed").alias("seed"))
    pairs = durable(pairs)
    # a seeded template of a document, as the company of its other templates; whole documents are in one window
    doc = W.partitionBy("doc_id")
    company = pairs.withColumn("_with", F.min(F.when(F.col("seed").isNotNull(), F.col("tid"))).over(doc))
    stats = company.groupBy("tid").agg(F.count(F.lit(1)).alias("docs"), F.count("_with").alias("accompanied"), F.count_distinct("_with").alias("partners"), F.max("seed").alias("kind"))
    near = (F.col("docs") >= rule.support) & (F.col("accompanied") >= rule.company * F.col("docs")) & (F.col("partners") >= rule.partners)
    why = F.when(F.col("kind").isNotNull(), "seeded").when(near, "associated")
    return stats.withColumn("why", why).where("why is not null").join(forms, "tid").withColumn("kind", F.coalesce("kind", F.lit("page"))), pairs


def find_residue(docs: DataFrame, rule: TreeRule = TreeRule()) -> DataFrame:
    """doc_id, direct, kinds (sorted) of every document with residue."""
    scanned = durable(scan(docs))
    templates, pairs = judged(scanned, rule)
    said = pairs.join(templates.select("tid", F.when(F.col("why") == "associated", "page").alias("_page")), "tid")
    by_message = said.select("doc_id", F.lit(False).alias("direct"), F.coalesce("seed", "_page").alias("kind")).where("kind is not null")
    alone = scanned.where("direct").select("doc_id", "direct", F.lit("slot").alias("kind"))
    return by_message.unionByName(alone).groupBy("doc_id").agg(F.max("direct").alias("direct"), F.array_sort(F.collect_set("kind")).alias("kinds"))
