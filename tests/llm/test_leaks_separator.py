"""What a text holds never moves the leaks of other texts, and markup of any length makes no difference."""

from barkeel.llm.leaks import find_leaks, normalise

WORDS = [f"word{i}" for i in range(20)]


def leaks_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, " ".join(WORDS))], "item_id long, passage string")
    return {(r.doc_id, r.covered_words) for r in find_leaks(docs, items).collect()}


def test_control_characters_in_any_place(spark):
    passage, noise = " ".join(WORDS), "a \\u0001 b \x01 c &#1; \\u0000 \\ud83d"
    for at in range(4):
        texts = ["plain", passage, "x " + passage.replace("word5", "\\u0001word5"), "end"]
        texts.insert(at, noise)
        want = {(texts.index(passage), 20), (next(i for i, t in enumerate(texts) if t.startswith("x ")), 20)}
        assert leaks_of(spark, texts) == want


def test_long_markup(spark):
    tag = f'<a href="https://example.org/{"p" * 300}" class="x" hidden>'
    inside = " ".join([*WORDS[:9], tag, *WORDS[9:], "</a>"])
    comment = " ".join([*WORDS[:9], "<!--", "c " * 900, "-->", *WORDS[9:]])
    link = " ".join([*WORDS[:9], f"[{WORDS[9]}](https://example.org/{'q' * 300})", *WORDS[10:]])
    assert leaks_of(spark, [inside, comment, link]) == {(0, 20), (1, 20), (2, 20)}
    assert normalise("if a <b then c > d, <3 x <- y").split() == "if a d, <3 x <- y".split()
    normalise("<a " * 20_000 + "<!--" * 20_000 + "<a b=" * 20_000)  # ends at once


def test_halves_of_one_character():
    assert normalise("\\ud835\\udc00bc") == "abc"
