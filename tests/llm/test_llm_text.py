import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barkeel.llm import leaks, residue
from barkeel.llm.leaks import LeakRule, find_leaks, rolling, tile, word_hashes
from barkeel.llm.pieces import CutRule, cut, split_items, strength
from barkeel.llm.residue import TreeRule, find_residue, mask, mine

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("ban", "der", "fil", "gor", "hul", "jin", "kep", "lum")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,é漢。", max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_cuts_partition_the_text(text, limit, overlap):
    spans = cut(text, CutRule(limit, overlap))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(e - max(0, s - overlap) <= limit for s, e in spans)
    assert (len(spans) > 1) == (len(text) > limit)


def test_cuts_prefer_strong_boundaries():
    text = "one two three. four five six.\n\nseven eight, nine ten. eleven twelve."
    spans = cut(text, CutRule(40, 0))
    assert [text[s:e].strip() for s, e in spans] == ["one two three. four five six.", "seven eight, nine ten. eleven twelve."]
    assert strength("a.\n\n") > strength("a\n") > strength("a. ") > strength("a, ") > strength("a ") > strength("a")
    with pytest.raises(ValueError):
        CutRule(10, 10)


def test_pieces_frame(spark):
    long = prose(random.Random(1), 20000)
    rows = [(1, None, "c"), (2, "", "c"), (3, "x" * 1400, "c"), (4, "x" * 1401, None), (5, long, "c"), (5, long, "c"), (6, "漢" * 3000, "c")]
    df = spark.createDataFrame(rows, "para_id long, text string, piece string")
    out = split_items(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.para_id, []).append(r)
    assert set(by) == {2, 3, 4, 5, 6} and len(by[2]) == len(by[3]) == 1 and len(by[4]) == 2
    one = sorted({(r.piece, r.start, r.end, r.overlap, r.piece_text) for r in by[5]})
    assert "".join(t[o:] for _, _, _, o, t in one) == long and all(len(t) <= 1400 for *_, t in one)
    assert len(by[5]) == 2 * len(one) and all(r.overlap == 100 for r in by[6] if r.piece > 1)
    assert split_items(df.limit(0)).count() == 0


def brute_cover(doc, item, run=8):
    """Words of item in stretches of ``run`` or more that occur in doc: an upper bound of any tiling."""
    seeds = {tuple(doc[i : i + run]) for i in range(len(doc) - run + 1)}
    hit = set()
    for k in range(len(item) - run + 1):
        if tuple(item[k : k + run]) in seeds:
            hit.update(range(k, k + run))
    return len(hit)


def test_tiling_finds_moved_stretches():
    rng = random.Random(2)
    for _ in range(30):
        item = [rng.randrange(1, 10**6) for _ in range(60)]
        parts = [item[0:20], item[20:33], item[33:60]]
        rng.shuffle(parts)
        doc = []
        for p in parts:
            doc += [rng.randrange(10**6, 10**7) for _ in range(rng.randrange(3, 9))] + p
        got = tile(np.array(doc, dtype=np.uint64), np.array(item, dtype=np.uint64), 8)
        assert got == brute_cover(doc, item) == 60


def test_leaks(spark):
    rng = random.Random(3)
    passages = [prose(rng, 40) + f" it's no{i} café 1.{i}" for i in range(5)] + [None, "", "few words only"]
    w = passages[0].split()
    disguised = "<p>" + passages[1].upper().replace(" ", "  ").replace("é", "\\u00e9") + "</p>"
    split = passages[2][:30] + "-\n" + passages[2][30:] if passages[2][30] != " " and passages[2][29] != " " else passages[2][:31] + "-\n" + passages[2][31:]
    docs = [
        (1, prose(rng, 100) + " " + passages[0] + " " + prose(rng, 50)), (2, disguised), (3, "x " + split), (4, " ".join(w[:7]) + " zz " + " ".join(w[10:17])), (5, " ".join(w[20:]) + " zz " + " ".join(w[:12])),
        (6, None), (7, ""), (8, prose(rng, 30000) + " " + passages[3]), (9, "​".join(passages[4])), (9, "​".join(passages[4])), (10, " ".join(w[:12])),
    ]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    got = sorted((r.doc_id, r.item_id) for r in find_leaks(d, e).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (5, 0), (8, 3), (9, 4)]
    crowded = sorted((r.doc_id, r.item_id) for r in find_leaks(d, e, LeakRule(filter_bits=8)).collect())  # a filter that lets most seeds through
    assert crowded == got
    assert find_leaks(d.limit(0), e).count() == 0 and find_leaks(d, e.limit(0)).count() == 0


def test_coverage_equals_brute_force():
    rng = random.Random(7)
    passages = [[rng.choice(WORDS[:12]) for _ in range(30)] for _ in range(6)]
    for _ in range(40):
        p = rng.choice(passages)
        a, b = sorted(rng.sample(range(31), 2))
        doc = [rng.choice(WORDS[12:]) for _ in range(5)] + p[a:b] + [rng.choice(WORDS[12:]) for _ in range(5)]
        words = word_hashes([" ".join(doc)])[0]
        for q in passages:
            assert tile(words, word_hashes([" ".join(q)])[0], 8) == brute_cover(doc, q)


def greedy(doc, item, run):
    """Greedy tiling by looking at all pairs of places, longest first, then the earliest in the document and in the item."""
    taken_d, taken_i, covered = set(), set(), 0
    while True:
        best = (run - 1, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in taken_d and b + n not in taken_i:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < run:
            return covered
        taken_d.update(range(a, a + n)), taken_i.update(range(b, b + n))
        covered += n


def test_tiles_of_repetitive_texts_equal_brute_force():
    rng = random.Random(5)
    for k in range(60):
        doc, item = ([rng.randrange(1, 2 + k % 3) for _ in range(rng.randrange(3, 40))] for _ in range(2))
        assert tile(np.array(doc, dtype=np.uint64), np.array(item, dtype=np.uint64), 3) == greedy(doc, item, 3)


def test_repeated_words_cost_no_more():
    doc, item = np.full(50_000, 7, dtype=np.uint64), np.full(20_000, 7, dtype=np.uint64)
    assert tile(doc, item, 8) == 20_000
    assert len(set(rolling(doc, 8).tolist())) == 1 and (rolling(np.arange(1, 40, dtype=np.uint64), 5)[3] == rolling(np.arange(4, 9, dtype=np.uint64), 5)[0])


RESIDUE = [
    "Dear {{ name }}, your recap is ready.", "Hello ${user}, thanks.", "Written by __AUTHOR__ on [SESSION_DATE].", "Entry at None, stop at None, result NoneR.", "Pattern null in regime null on null.",
    "See <insert chart> for more.", "TODO(author): text", "lorem ipsum dolor sit amet", "Chart\nComing soon\nEntry\n...", "Skip to content\n404 Not Found", "Error 502 | Bad Gateway", "Some text about\nHTTP 504 - Gateway Timeout",
    "You need to enable JavaScript to run this app.", "Access denied. Your address has been blocked.", "Traceback (most recent call last):\n  File \"a.py\", line 3, in <module>", '{"status": 500, "error": "Internal Server Error", "message": "x", "trace": "9a"}',
    "We are down for scheduled maintenance and will be back shortly.", "asdf qwer foo bla test asdf", "Your session has expired. Log in again to see this note.", "Loading chart... Loading chart...", "[Placeholder: text goes in this block]", "Bitte aktivieren Sie JavaScript, um die Grafik zu sehen.",
]
FINE = [
    "The export sheet writes `{title}` where the number goes.", "A test checks that a missing close is stored as null and never as zero.", "Risk was undefined in the first draft of the plan, which is why we sent it back.",
    "The order gateway answered with error 404 at noon, so we routed the exit by phone.", "To see the live chart you must enable JavaScript in the dashboard; the printed figures are below.", 'A reader told us that the old link showed "page not found"; it has moved.',
    "Scheduled maintenance on Tuesday did not touch the bar store, and the page about it is coming soon.", "Every desk removed every TODO from the rulebook and settled the thresholds.", "The set {H1, L2} and the range [0.1, 0.2] are used here.",
    "My session expired mid-trade at noon; since then the stop rests at the broker.", "El mentor cerró\ntodo\ncon cuidado.", "<p>Plain <b>markup</b>.</p>", "", "Access denied messages from the vendor delayed the download, yet the sample is complete.", "The replay stopped with a KeyError twice; the counts matched.",
]


def test_residue(spark):
    rows = [(i, t, "c") for i, t in enumerate(RESIDUE)] + [(100 + i, t, "c") for i, t in enumerate(FINE)] + [(200, None, "c"), (None, RESIDUE[0], "c"), (0, RESIDUE[0], "c"), (300, ("plain words of the day " * 20000) + RESIDUE[10], "c"), (301, ("plain words of the day. " * 20000) + RESIDUE[10], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = {r.doc_id for r in find_residue(df).collect()}
    assert got == set(range(len(RESIDUE))) | {301}
    assert find_residue(df.limit(0)).count() == 0


def test_templates_keep_cue_words():
    masked = sorted({mask(f"error {n} | {w.lower()}") for n in (404, 502) for w in ("Bad Gateway", "Not Found")})
    _, forms, _ = mine(masked, TreeRule())
    assert sorted(forms) == ["error <*> | bad gateway", "error <*> | not found"]
    masked = sorted(mask(f"could not load chart {w} for you") for w in ("one", "two", "three"))
    assert mine(masked, TreeRule())[1] == ["could not load chart <*> for you"]


def test_normalise():
    assert leaks.normalise("It&#39;s rar­​ely <b>two</b>-\nsided \\u00e9").split() == ["it's", "rarely", "two", "sided", "é"]
    assert residue.unfilled("`{x}`") is False and residue.unfilled("{x}") is True


def test_documents_are_read_once_and_not_shuffled(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    table, bits = leaks.seed_filter(leaks.item_side(spark.read.parquet(f"{small}/eval_items.parquet"), LeakRule()), LeakRule())
    plan = leaks.doc_side(d, spark.sparkContext.broadcast(table), bits, LeakRule())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
