"""The templates decide: variants keep a verdict, company gives one, prose in many wordings loses it."""

import random

from barkeel.llm.residue import TreeRule, classify, durable, find_residue, judged, messages, mine, scan

STEMS = ["Sign in to {}.", "Use this space to {}.", "Too many requests from your {}.", "Insert your {}.", "Enable javascript to open this {}."]
WORDS = {"Insert your {}.": ["title", "image", "quote", "name", "caption", "body", "date", "chart", "text"], "Enable javascript to open this {}.": ["site", "page", "app", "dashboard"]}
OTHERS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "zeta", "iota"]


def test_variants_keep_the_verdict(spark):
    texts = [stem.format(w) for stem in STEMS for w in WORDS.get(stem, OTHERS)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    alone = {i for i, t in enumerate(texts) if find_alone(t)}
    assert {texts[i].split()[0] for i in alone} == {s.split()[0] for s in STEMS}
    assert {r.doc_id for r in find_residue(df).collect()} == alone


def find_alone(text):
    return any(classify(m) for m in messages(text)[0])


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


NOTICES = ["404 Not Found", "502 Bad Gateway", "Access denied.", "Something went wrong."]
PROSE = ["The bar closed near its high.", "Volume was thin at noon.", "We waited for a second entry.", "The stop was hit twice."]


def test_pages_are_known_by_their_company(spark):
    rng = random.Random(1)
    known = [f"{NOTICES[i % 4]}\nReturn to the front desk\nTicket {rng.randrange(10**6)}" for i in range(24)]
    unknown = ["We mislaid this sheet.\nReturn to the front desk\nTicket 77", "Our shelves are being dusted.\nTicket 5"]
    fine = [f"{rng.choice(PROSE)} {rng.choice(PROSE)}" for _ in range(30)] + ["Return to the shop on Monday."]
    texts = known + unknown + fine
    assert not any(classify(m.lower()) for m in ("We mislaid this sheet.", "Return to the front desk", "ticket <*>"))
    df = frame(spark, texts)
    assert {r.doc_id for r in find_residue(df).collect()} == set(range(26))
    assert {r.doc_id for r in find_residue(df, TreeRule(support=1000)).collect()} == set(range(24))
    templates = {r.template: r.why for r in judged(durable(scan(df)))[0].collect()}
    assert templates["return to the front desk"] == templates["ticket <*>"] == "associated" and templates["access denied."] == "seeded"


def test_copies_of_one_page_give_no_company(spark):
    texts = ["404 Not Found\nThe bar closed near its high."] * 6 + ["The bar closed near its high."]
    assert {r.doc_id for r in find_residue(frame(spark, texts)).collect()} == set(range(6))


def test_prose_in_many_wordings_is_freed(spark):
    rng = random.Random(2)
    pick = lambda *w: rng.choice(w)
    said = sorted({f"You are not allowed to {pick('widen', 'move', 'drop')} the stop {pick('after', 'before', 'near')} the {pick('bell', 'open', 'close')} on {pick('calm', 'busy', 'odd')} days" for _ in range(200)})
    assert all(classify(m.lower()) for m in said)
    df = frame(spark, [*said, "You are not allowed to see this journal."])
    assert {r.doc_id for r in find_residue(df).collect()} == {len(said)}
    assert len(find_residue(df, TreeRule(free_forms=10**6)).collect()) == len(said) + 1


def test_filler_needs_no_list():
    latin = "Quadrum modus velora manet. Alveus perenna modus velora. Manet quadrum velora modus alveus. Perenna modus manet velora."
    filler = lambda text: messages(text)[1]
    assert filler(latin) and filler("zork plum zork plum vrax zork") and filler("asdf qwer asdf bla test")
    for fine in ("", "one", "Lower lower high amid muted interest", "home charts journal desk menu search contact about", "la sesión abrió con calma y la sesión cerró con calma", "stop hit. stop moved. stop held after all"):
        assert not filler(fine)


def test_large_leaves_are_split(spark):
    rng = random.Random(3)
    texts = [f"error in the {''.join(rng.choices('abcdefgh', k=6))} ledger of room {rng.randrange(99)}" for _ in range(300)] + ["Error 404 Not Found"] * 3
    got = [{r.doc_id for r in find_residue(frame(spark, texts), TreeRule(leaf=n)).collect()} for n in (16, 1024)]
    assert got[0] == got[1] == {300, 301, 302}
    assert mine(["a b c", "a b d"], TreeRule()) == ([0, 0], ["a b <*>"], [1])
