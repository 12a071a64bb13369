import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from barkeel.config import KnowledgeConfig, Pipeline
from barkeel.operators import explain, text, vectors
from barkeel.sources import store, vendor
from barkeel.sources.sql import QueryEngine

D = dt.datetime


def minute_bars(spark, n=40, symbol="A"):
    t0 = D(2025, 1, 2, 14, 30)
    return spark.createDataFrame([(symbol, "1m", t0 + dt.timedelta(minutes=i), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 1.0) for i in range(n)], "symbol string, timeframe string, timestamp timestamp, open double, high double, low double, close double, volume double")


def test_store(spark, tmp_path):
    s = store.BarStore(spark, str(tmp_path / "bars"))
    counts = {(r.symbol, r.timeframe): r.n_bars for r in s.write_timeframes(minute_bars(spark), "v1").collect()}
    assert counts == {("A", "1m"): 40, ("A", "5m"): 8, ("A", "15m"): 3, ("A", "30m"): 2}
    s.write(minute_bars(spark, 3, "B"), "v2", {"source": "x"})
    s.write(minute_bars(spark, 5), "v2")  # replaces A 1m only
    assert s.read("A", "1m").count() == 5 and s.read("A", "5m").count() == 8 and s.read("B").count() == 3
    assert [tuple(r) for r in s.datasets().collect()][0] == ("A", "15m")
    plan = s.read("A", "1m")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan
    for bad in ("a/b", "..", "x y"):
        if bad != "..":
            with pytest.raises(ValueError):
                s.path(bad, "1m")
    assert store.BarStore(spark, str(tmp_path / "m")).path("A", "1m").endswith("symbol=A/timeframe=1m")
    s2 = store.BarStore(spark, str(tmp_path / "one"))
    s2.write(minute_bars(spark, 3), "v9", {"source": "x"})
    assert spark.read.parquet(s2.path("A", "1m")).schema["timestamp"].metadata["strategy_version"] == "v9"


def test_files(spark, tmp_path):
    csv = tmp_path / "b.csv"
    csv.write_text("Timestamp,Open,High,Low,Close,Volume\n1735828200,1,2,0.5,1.5,3\n1735828260,1,2,0.5,1.5,3\n")
    assert store.load_ohlcv(spark, str(csv), "s").count() == 2
    with pytest.raises(ValueError):
        store.load_ohlcv(spark, str(tmp_path / "b.xls"))
    named = tmp_path / "c.csv"
    named.write_text("when,open,high,low,close,volume\n2025-01-02T10:00:00Z,1,2,0.5,1.5,3\n")
    assert store.load_ohlcv(spark, str(named), renames={"when": "timestamp"}).first().timestamp == D(2025, 1, 2, 10)
    empty = store.read_tolerant(spark, str(tmp_path / "none"), "a int, b string")
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    spark.createDataFrame([(1, 2)], "a int, z int").write.parquet(str(tmp_path / "some"))
    assert store.read_tolerant(spark, str(tmp_path / "some"), "a int, b string").collect() == [(1, None)]
    store.export_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == "x"


def test_chunks_upsert_experiment(spark, tmp_path):
    a = minute_bars(spark, 3).withColumn("rank", F.lit(1))
    b = minute_bars(spark, 2).withColumns({"rank": F.lit(2), "close": F.lit(9.0)})
    merged = store.merge_chunks(a.unionByName(b), "rank", dt.date(2025, 1, 2), dt.date(2025, 1, 2)).orderBy("timestamp").collect()
    assert [r.close for r in merged] == [9.0, 9.0, 3.5]
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(store.upsert(t, spark.createDataFrame([("b", 3)], "k string, v int"), ["k"]).collect()) == [("a", 1), ("b", 3)]
    name = store.write_experiment(t, t.limit(1), str(tmp_path / "exp"), "My Run!", Pipeline())
    assert name.startswith("my-run_")
    listed = store.experiments(spark, str(tmp_path / "exp")).collect()
    assert listed[0].experiment == name and json.loads(listed[0].config)["setup"]["context_lookback"] == 20


def test_sql_engine(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(str(tmp_path / "t" / "p=1"))
    spark.createDataFrame([(2,)], "x int").write.parquet(str(tmp_path / "t" / "p=2"))
    with QueryEngine(spark) as q:
        q.register_parquet("t", str(tmp_path / "t" / "p=*"), str(tmp_path / "t"))
        assert [tuple(r) for r in q.query("select x, y, p from t where x >= ? order by x", [1]).collect()] == [(1, "a", 1), (2, None, 2)]
        assert q.query("select count(*) c from t where x = :x", {"x": 2}).first().c == 1
        with pytest.raises(ValueError):
            q.register_frame("a b", spark.range(1))
    with pytest.raises(RuntimeError):
        q.query("select 1")


class Fake:
    def minute_bars(self, symbol, start, end):
        return [(start + dt.timedelta(minutes=i), 1.0, 2.0, 0.5, 1.5, 3.0) for i in range(2)]


def fake_client():
    return Fake()


def test_vendor(spark):
    waits = []

    def flaky(state=[0]):  # noqa: B006
        state[0] += 1
        if state[0] < 3:
            raise OSError("busy")
        return [1]

    assert vendor.with_retry(flaky, sleep=waits.append) == [1] and waits == [10.0, 20.0]
    with pytest.raises(vendor.VendorError):
        vendor.with_retry(lambda: 1 / 0, attempts=2, sleep=waits.append)
    spans = list(vendor.windows(D(2025, 1, 1), D(2025, 3, 1)))
    assert spans[0][1] == D(2025, 3, 1) and spans[-1][0] == D(2025, 1, 1) and all(a[0] == b[1] for a, b in zip(spans, spans[1:]))
    got = vendor.download(spark, ["A", "B"], "2025-01-01", "2025-02-15", "test_sources_text:fake_client")
    assert got.rdd.getNumPartitions() == 4 and got.schema == spark.createDataFrame([], vendor.SCHEMA).schema
    with pytest.raises(vendor.VendorError, match="no bars"):
        vendor.bars_frame(spark, "A", [])


def test_markdown(spark):
    md = "intro *one*\nstill one\n\n# **Top** x\n- item [a](b) `c`\n\n### Sec\ntext\n```\nhidden\n# no\n```\nafter\n## Two\n12) last ![i](u)"
    rows = text.markdown_paragraphs(spark.createDataFrame([("f", md), ("g", None), ("h", "")], "source_file string, text string"), "source_file").orderBy("seq").collect()
    assert [(r.chapter, r.section, r.paragraph, r.text) for r in rows] == [("Front Matter", None, 1, "intro *one* still one"), ("Top x", None, 1, "item a c"), ("Top x", "Sec", 2, "text"), ("Top x", "Sec", 3, "after"), ("Two", None, 1, "last i")]


def test_html_and_epub(spark):
    html = "<html><h1>Cap &amp; Co</h1><p>one <b>two</b></p><h2>S</h2><ul><li><p>in</p></li></ul><p>"
    assert text.html_to_paragraphs(html, "x") == [("Cap & Co", None, 1, "one two"), ("Cap & Co", "S", 2, "in"), ("Cap & Co", "S", 3, "in")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="http://o" xmlns:dc="http://dc"><metadata><dc:title> My  Book </dc:title></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="b" href="b_two.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="a"/><itemref idref="b"/></spine></package>')
        for n, body in (("nav", "<p>no</p>"), ("a", html), ("b_two", "<p>plain</p>")):
            z.writestr(f"O/{n}.xhtml", body)
    rows = text.epub_paragraphs(spark.createDataFrame([("x/My.epub", bytearray(data.getvalue()))], "path string, content binary")).orderBy("seq").collect()
    assert [(r.book, r.chapter, r.text, r.source_document) for r in rows] == [("My Book", "Cap & Co", "one two", "a.xhtml"), ("My Book", "Cap & Co", "in", "a.xhtml"), ("My Book", "Cap & Co", "in", "a.xhtml"), ("My Book", "b two", "plain", "b_two.xhtml")]


def test_chunking(spark):
    cfg = KnowledgeConfig(target_characters=20, maximum_characters=30, overlap_paragraphs=1)
    assert text.pack([10, 10, 10, 10], cfg) == [(0, 2), (1, 3), (2, 4)]
    assert text.pack([30, 30], cfg) == [(0, 1), (1, 2)] and text.pack([], cfg) == []
    assert text.split_words("aa bb " + "c" * 70, 30) == ["aa bb", "c" * 30, "c" * 30, "c" * 10]
    rows = [(1, "B", "c1", None, 1, "x" * 25, "f", "d1"), (2, "B", "c1", None, 2, "".join(chr(97 + i % 23) for i in range(80)), "f", None), (3, "B", "c1", "s", 3, "zz", "f", "d2"), (4, "B", "c1", None, 4, "back", "f", "d1"), (5, "B", "c1", None, 5, "  ", "f", "d1")]
    df = spark.createDataFrame(rows, "n long, book string, chapter string, section string, paragraph int, text string, source_file string, source_document string")
    got = text.chunks(df, "n", cfg).collect()
    assert len({r.chunk_id for r in got}) == len(got) and all(len(r.text) <= 30 for r in got)
    assert {r.source_reference for r in got} >= {"B | c1 | s | paragraphs 3-3", "B | c1 | paragraphs 4-4"}


def test_index_round_trip_and_search(spark, tmp_path):
    df = spark.createDataFrame([(i, "B" if i % 2 else "C", "c", None, i, t, "f", "d") for i, t in enumerate(["bull flag in a trend", "double bottom at the low", "wedge top reversal", "tight trading range"], 1)], "n long, book string, chapter string, section string, paragraph int, text string, source_file string, source_document string")
    chunked = text.chunks(df, "n", KnowledgeConfig(target_characters=1))
    store.save_index(chunked, text.embed(chunked, "chunk_id", "text"), str(tmp_path / "i"))
    from barkeel.cli import search

    best = search(spark, str(tmp_path / "i"), "Double bottom low", 2, None, Pipeline()).collect()
    assert best[0].text == "double bottom at the low" and len(best) == 2
    assert search(spark, str(tmp_path / "i"), "double bottom low", 1, "B", Pipeline()).first().text != "double bottom at the low"
    with pytest.raises(ValueError):
        search(spark, str(tmp_path / "i"), " ", 1, None, Pipeline())
    chunked.limit(1).write.mode("overwrite").parquet(str(tmp_path / "i" / "chunks"))
    with pytest.raises(ValueError, match="manifest"):
        store.load_index(spark, str(tmp_path / "i"))


def test_vectors_equal_plain_sums(spark):
    import hashlib
    import math

    cfg, texts = KnowledgeConfig(dimension=64), ["Straße straße", "", "the old low, the old high", "a", "鿿㐀 it's"]
    rows = {r.id: r for r in text.embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", cfg, sparse=True).collect()}
    dense = {r.id: r.vector for r in text.embed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", cfg).collect()}
    for i, t in enumerate(texts):
        want: dict[int, float] = {}
        for name, n in text.feature_names(t, cfg).items():
            place = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") % 64
            want[place] = want.get(place, 0.0) + 1.0 + math.log1p(n)
        length = math.sqrt(sum(v * v for v in want.values())) or 1.0
        assert rows[i].places == sorted(want) and all(abs(w - want[p] / length) < 1e-6 for p, w in zip(rows[i].places, rows[i].weights))
        assert [k for k, v in enumerate(dense[i]) if v] == sorted(want)
    assert set(text.feature_names("Straße straße", cfg)) == {"w1:strasse", "w2:strasse strasse", "c3:str", "c3:tra", "c3:ras", "c3:ass", "c3:sse", "c3:ses", "c3:est"}


def test_top_k_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (200, 8)).astype(float)
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(m)] + [(999, None)], "id long, v array<double>").repartition(5)
    for block in (7, 4096):
        got = {}
        for r in vectors.top_k(df, df.where("id % 20 = 0"), "id", "v", 4, block=block).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.id
        for q, ranks in got.items():
            s = m @ m[q]
            assert [ranks[k] for k in (1, 2, 3, 4)] == sorted(range(200), key=lambda i: (-s[i], i))[:4]
        assert set(got) == set(range(0, 200, 20))
    assert vectors.top_k(df, df.limit(0), "id", "v").count() == 0


def provider(system, user):
    if "bad" in user:
        raise TimeoutError
    say = "level 5" if "digits" in user else "calm"
    return json.dumps({f: say for f in explain.FIELDS})


def test_explanations(spark):
    s = spark.createDataFrame([("a", "LONG"), ("bad", "LONG"), ("digits", "SHORT")], "k string, direction string")
    refs = spark.createDataFrame([("a", 1, "id", "ref", "text")], "k string, rank int, chunk_id string, source_reference string, text string")
    p = explain.prompts(s, "k", refs)
    assert "UNTRUSTED_DATA" in p.first().user_prompt
    got = {r.k: (r.status, r.error_type, r.warnings) for r in explain.generate(p, "k", provider).collect()}
    assert got == {"a": ("GENERATED", None, "calm"), "bad": ("FAILED", "TimeoutError", None), "digits": ("FAILED", "ValueError", None)}


def test_rules(spark):
    schema = "name string, status string, reviewer string, reviewed_at string, source_verified boolean"
    rows = [("a", "approved", "me", "t", True), ("b", "approved", None, "t", True), ("c", "draft", None, None, None)]
    assert [r.status for r in store.gated_rules(spark.createDataFrame(rows, schema)).orderBy("name").collect()] == ["approved", "candidate", "draft"]
    with pytest.raises(ValueError):
        store.gated_rules(spark.createDataFrame([*rows, (" A ", "draft", None, None, None)], schema))


def test_paragraph_lines(spark, tmp_path):
    p = spark.createDataFrame([("b", "c", None, 1, "t", "f", "d")], "book string, chapter string, section string, paragraph int, text string, source_file string, source_document string")
    store.write_paragraphs(p, str(tmp_path / "p"))
    assert store.read_paragraphs(spark, str(tmp_path / "p")).first().text == "t"
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "x.json").write_text("{broken\n")
    with pytest.raises(Exception):  # noqa: B017
        store.read_paragraphs(spark, str(tmp_path / "q")).collect()


def test_chunks_are_requested_once_paced_and_repaired(spark, tmp_path):
    class Counting:
        asked, pauses = [], []

        def resolve(self, symbol):
            return [symbol] if symbol != "AMB" else ["x", "y"]

        def errors(self):
            return [(2104, "farm ok")] if "BAD" not in str(self.asked[-1]) else [(200, "no definition")]

        def minute_bars(self, symbol, start, end):
            self.asked.append((symbol, start))
            price = 5.0 if end - start == dt.timedelta(days=1) else 1.0
            return [(start + dt.timedelta(hours=15, minutes=i), price, price + 1, price - 0.5, price, 1.0) for i in range(3)]

    client, chunks = Counting(), store.ChunkStore(spark, str(tmp_path / "c"))
    asked = vendor.download_chunks(chunks, client, ["A"], D(2025, 1, 1), D(2025, 2, 20), sleep=client.pauses.append)
    assert [d for _, d in asked] == [dt.date(2025, 2, 20), dt.date(2025, 1, 21)] and client.pauses == [11.0]
    assert vendor.download_chunks(chunks, client, ["A"], D(2025, 1, 1), D(2025, 2, 20), sleep=client.pauses.append) == []
    assert chunks.request("A", dt.date(2025, 2, 20))["start"] == "2025-01-21T00:00:00"
    missing = spark.createDataFrame([("A", dt.date(2025, 1, 21))], "symbol string, session_date date")
    assert vendor.repair_sessions(chunks, client, "A", missing, sleep=client.pauses.append) == [dt.date(2025, 1, 21)]
    assert vendor.repair_sessions(chunks, client, "A", missing, sleep=client.pauses.append) == []
    assert {r.timestamp.date(): r.close for r in chunks.merged().collect()} == {dt.date(2025, 1, 1): 1.0, dt.date(2025, 1, 21): 5.0}
    for symbol in ("AMB", "BAD"):
        with pytest.raises(vendor.VendorError):
            vendor.fetch(client, symbol, D(2025, 1, 1), D(2025, 1, 2))


def test_typed_sinks_keep_their_schema(spark, tmp_path):
    none = spark.createDataFrame([], "symbol string, extra int")
    store.write_trade_log(none, str(tmp_path / "t")), store.write_statistics(none, str(tmp_path / "s"))
    assert len(spark.read.parquet(str(tmp_path / "t")).columns) == 38 and len(spark.read.parquet(str(tmp_path / "s")).columns) == 26
    rows = spark.createDataFrame([("b", D(2025, 1, 2), 1), ("a", D(2025, 1, 2), 2), ("c", D(2025, 1, 1), 3)], "trade_id string, entry_time timestamp, bars_held bigint")
    store.write_trade_log(rows, str(tmp_path / "t"))
    got = store.read_trade_log(spark, str(tmp_path / "t"))
    assert [r.trade_id for r in got.collect()] == ["c", "a", "b"] and dict(got.dtypes)["bars_held"] == "int"
    assert store.read_statistics(spark, str(tmp_path / "none")).count() == 0
    for folder in ("trades/experiment=a_1", "trades/experiment=b_2", "trades/default"):
        rows.write.parquet(str(tmp_path / "x" / folder))
    assert [p.rsplit("/", 1)[1] for p in store.artifacts(spark, str(tmp_path / "x"))] == ["default", "experiment=b_2", "experiment=a_1"]
    store.write_manifest(spark.createDataFrame([("SPY", 1)], "symbol string, n int"), spark.createDataFrame([("QQQ", 2), ("SPY", 3)], "symbol string, n int"), ["symbol"], str(tmp_path / "m"))
    assert [(r.symbol, r.n) for r in spark.read.json(str(tmp_path / "m")).collect()] == [("QQQ", 2), ("SPY", 3)]


def test_index_knows_its_content(spark, tmp_path):
    paragraphs = spark.createDataFrame([(i, "B", "One", None, i, f"second entry number {i}", "b.md", "b.md") for i in range(1, 4)], "seq long, book string, chapter string, section string, paragraph int, text string, source_file string, source_document string")
    chunked = text.chunks(paragraphs, "seq", KnowledgeConfig(target_characters=20, maximum_characters=40))
    base = str(tmp_path / "i")
    store.save_index(chunked, text.embed(chunked, "chunk_id", "text"), base)
    assert store.load_index(spark, base)[0].count() == 3
    kept = {n: [tuple(r) for r in spark.read.parquet(f"{base}/{n}").collect()] for n in ("chunks", "vectors")}
    for name, change in (("chunks", F.concat("text", F.lit("!"))), ("vectors", F.transform("vector", lambda x: x * 2))):
        schema, column = spark.read.parquet(f"{base}/{name}").schema, "text" if name == "chunks" else "vector"
        spark.createDataFrame(kept[name], schema).withColumn(column, change.cast(schema[column].dataType)).write.mode("overwrite").parquet(f"{base}/{name}")
        with pytest.raises(ValueError, match=name):
            store.load_index(spark, base)
        spark.createDataFrame(kept[name], schema).write.mode("overwrite").parquet(f"{base}/{name}")
    assert store.load_index(spark, base)[1].count() == 3


def test_paragraph_lines_and_books(spark, tmp_path):
    good = {"book": "B", "chapter": "C", "section": None, "paragraph": 1, "text": "x", "source_file": "f", "source_document": "f"}
    (tmp_path / "p.jsonl").write_text("\n".join([json.dumps(good), "", json.dumps(good)]))
    assert store.read_paragraphs(spark, str(tmp_path / "p.jsonl")).count() == 2
    (tmp_path / "q.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps(good | {"text": None})]))
    with pytest.raises(ValueError, match=r"lines \[3, 4\]"):
        store.read_paragraphs(spark, str(tmp_path / "q.jsonl"))
    (tmp_path / "book.md").write_text("# One\n\nText of **one**.\n")
    assert [(r.book, r.chapter, r.text) for r in store.parse_book(spark, str(tmp_path / "book.md")).collect()] == [("book", "One", "Text of one.")]
    with pytest.raises(ValueError):
        store.parse_book(spark, "a.pdf")


def test_statistics_in_prompts(spark):
    s = spark.createDataFrame([("k", "A", "5m", "v", "H2", "BULL_TREND", "LONG")], "k string, symbol string, timeframe string, strategy_version string, pattern_type string, regime string, direction string")
    cols = ["total", "wins", "losses", "win_rate", "probability_win", "expectancy_r", "profit_factor", "max_drawdown"]
    row = ("A", "5m", "v", "PATTERN_REGIME", "H2", "BULL_TREND", *[1.0] * len(cols))
    schema = "symbol string, timeframe string, strategy_version string, scope string, pattern_type string, market_regime string, " + ", ".join(f"{c} double" for c in cols)
    stats = spark.createDataFrame([row, ("A", "5m", "w", *row[3:]), (*row[:3], "PATTERN", *row[4:])], schema)
    found = explain.matching_statistics(s, "k", stats)
    assert [r.statistics.total for r in found.collect()] == [1.0]
    prompt = explain.prompts(s, "k", None, found).first().user_prompt
    assert json.loads(prompt.split("\n")[2])["statistics"]["win_rate"] == 1.0
    with pytest.raises(ValueError, match="several"):
        explain.matching_statistics(s, "k", stats.unionByName(stats))
    explain.require_provenance(s, "k", stats.where("strategy_version = 'v'").withColumn("k", F.lit("k")))
    with pytest.raises(ValueError, match="another series"):
        explain.require_provenance(s, "k", stats.withColumn("k", F.lit("k")))


def test_database_and_progress(spark, tmp_path):
    from barkeel.session import clear_durable, durable, watched

    with QueryEngine(spark, str(tmp_path / "db")) as q:
        q.save("t", spark.range(5))
    with QueryEngine(spark, str(tmp_path / "db"), read_only=True) as q:
        assert q.query("select count(*) n from t").first().n == 5
        with pytest.raises(PermissionError):
            q.save("u", spark.range(1))
    with pytest.raises(FileNotFoundError):
        QueryEngine(spark, str(tmp_path / "no"), read_only=True)
    told = []
    assert watched(spark.range(1000).repartition(7), lambda a, b: told.append((a, b)), 0.01).count() == 1000
    assert told[0] == (0, 0) and told[-1][0] == told[-1][1] > 0 and told == sorted(told)
    assert durable(spark.range(3)).count() == 3 and clear_durable(spark) >= 2 and clear_durable(spark) == 0
