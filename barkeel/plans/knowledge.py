"""Queries over texts, vectors, the SQL façade, the store and the streaming twins."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barkeel.config import Pipeline
from barkeel.operators import explain, features, patterns, setups, statistics, text, vectors
from barkeel.operators.blocks import SERIES
from barkeel.plans.market import Source, _clean, _log, _stages, event_bars, settings
from barkeel.plans.market_sql import _BARS, _CLEAN, _SETUPS, delivered
from barkeel.plans.settings import WIDE
from barkeel.plans.tables import table
from barkeel.session import durable, shared_dir
from barkeel.sources.sql import QueryEngine
from barkeel.sources.store import BarStore, gated_rules, upsert
from barkeel.streaming.pipeline import bars_from_ticks, pattern_stream


def markdown_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every document read as Markdown."""
    found = text.markdown_paragraphs(table(spark, d, "documents").select(F.col("doc_id"), "text"), "doc_id")
    return found.select(F.col("source_file").alias("doc"), "chapter", "section", "paragraph", "text")


def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every document read as HTML."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("<h1>"), F.coalesce("source", F.lit("")), F.lit("</h1><p>"), F.col("text"), F.lit("</p>")).alias("html"))
    found = text.html_paragraphs(docs, "doc_id", "html")
    return found.select(F.col("source_file").alias("doc"), "chapter", "section", "paragraph", "text")


def knowledge_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = text.chunks(table(spark, d, "book_paragraphs"), "para_id")
    return c.select("chunk_id", "book", "chapter", "section", "paragraph_start", "paragraph_end", F.length("text").alias("n_chars"), "source_reference")


def ngram_features(spark: SparkSession, d: str) -> DataFrame:
    """How often each word and word pair occurs in all paragraphs."""
    tokens = table(spark, d, "book_paragraphs").where("text is not null").select(text.words(F.col("text")).alias("w"))
    both = tokens.select(F.explode(F.concat(F.transform("w", lambda x: F.concat(F.lit("w1:"), x)), F.transform(text.ngrams(F.col("w"), 2), lambda x: F.concat(F.lit("w2:"), x)))).alias("feature"))
    return both.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Per paragraph, how many of the 1024 places are set, and the vector's squared length."""
    v = text.embed(table(spark, d, "book_paragraphs").where("text is not null"), "para_id", "text", sparse=True)
    return v.select("para_id", F.size("places").alias("n_set"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm2"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20, itself included."""
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query_id", "vec_id", "score", "rank")


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among the vectors of label 0: the filter comes before the ranking."""
    e = table(spark, d, "embeddings")
    return vectors.top_k(e.where("label = 0"), e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query_id", "vec_id", "score", "rank")


def passage_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Three best paragraphs for every evaluation passage whose id is divisible by 20."""
    paragraphs = text.embed(table(spark, d, "book_paragraphs").where("text is not null").select(F.col("para_id").alias("id"), "text"), "id", "text")
    asked = text.embed(table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("id"), F.col("passage").alias("text")), "id", "text")
    return vectors.top_k(paragraphs, asked, "id", "vector", 3, digits=4).select("query_id", F.col("id").alias("para_id"), "score", "rank")


def explanation_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Per signal, its search words, the passages found for them, its evidence and the parts of its prompt."""
    _, evaluated = _stages(spark, d)
    q = explain.retrieval_query(F.col("direction"), F.col("pattern_type"), F.col("regime"))
    cols = [*SERIES, "direction", "pattern_type", "regime", "strategy_version"]
    s = durable(setups.signals(evaluated).select(F.concat_ws("-", "symbol", "bar_index").alias("signal_id"), *cols, explain.evidence(F.col("reasons"), F.col("warnings")).alias("evidence"), q.alias("query")))
    chunked = durable(text.chunks(table(spark, d, "book_paragraphs"), "para_id"))
    asked = s.select(F.col("query").alias("id"), F.col("query").alias("text")).distinct()  # a few per pattern and regime
    ranked = vectors.top_k(text.embed(chunked.select(F.col("chunk_id").alias("id"), "text"), "id", "text"), text.embed(asked, "id", "text"), "id", "vector", 3, digits=4)
    found = ranked.select(F.col("query_id").alias("query"), F.col("id").alias("chunk_id"), "rank").join(chunked.select("chunk_id", "source_reference", "text"), "chunk_id")
    references = durable(s.select("signal_id", "query").join(found, "query").drop("query"))
    known = explain.matching_statistics(s, "signal_id", statistics.setup_statistics(_log(spark, d)))
    p = explain.prompts(s.drop("query"), "signal_id", references, known)
    cited = references.groupBy("signal_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: F.substring(x["chunk_id"], 1, 12)), ",").alias("cited"))
    facts = p.join(s.select("signal_id", "query", "evidence"), "signal_id").join(cited, "signal_id", "left")
    return facts.select(
        "signal_id", "query", F.size("evidence").alias("n_evidence"), explain.has_numeric_claim(F.array_join("evidence", " ")).alias("numeric_claim"), "cited",
        F.size(F.from_json(F.element_at(F.split("user_prompt", "\n"), 3), "references array<struct<rank:int>>")["references"]).alias("n_references"),
    )


def sql_parameterized(spark: SparkSession, d: str) -> DataFrame:
    engine = QueryEngine(spark)
    engine.register_parquet("q_orders", f"{d}/orders.parquet")
    engine.register_parquet("q_customer", f"{d}/customer.parquet")
    engine.register_parquet("q_nation", f"{d}/nation.parquet")
    sql = """SELECT n.n_name, o.o_orderpriority, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM q_orders o JOIN q_customer c ON o.o_custkey = c.c_custkey
             JOIN q_nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > CAST(:least AS DOUBLE) GROUP BY n.n_name, o.o_orderpriority"""
    return engine.query(sql, {"least": 100000.0})


def sql_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    engine = QueryEngine(spark)
    engine.register_parquet("q_lineitem", f"{d}/lineitem.parquet")
    return engine.query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM q_lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")


def sql_set_difference(spark: SparkSession, d: str) -> DataFrame:
    engine = QueryEngine(spark)
    engine.register_parquet("q_c", f"{d}/customer.parquet")
    engine.register_parquet("q_o", f"{d}/orders.parquet")
    return engine.query("SELECT c_custkey FROM q_c EXCEPT SELECT o_custkey FROM q_o WHERE o_totalprice > :much", {"much": 400000.0})


def partition_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Series of a store that was just written from the delivered bars."""
    store = BarStore(spark, _fresh(spark, "catalog"))
    store.write(_clean(spark, d).select(*features.BARS), WIDE.strategy_version)
    return store.read().groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("n_bars"))


def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Feeds after an upsert of those that declare no zone."""
    feeds = table(spark, d, "feeds")
    return upsert(feeds, feeds.where("zone_name is null").withColumn("zone_name", F.lit("UTC")), ["feed"])


def rule_gate(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items as a rule library: only even ones have a reviewer."""
    rules = table(spark, d, "eval_items").select(
        F.concat(F.lit("rule "), F.col("item_id")).alias("name"), F.lit("approved").alias("status"), F.when(F.col("item_id") % 2 == 0, "desk").alias("reviewer"),
        F.lit("2025-01-01").alias("reviewed_at"), (F.col("lang") == "en").alias("source_verified"),
    )
    return gated_rules(rules).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the events as a stream that ends with the input."""
    schema = table(spark, d, "events").schema
    reader = spark.readStream.schema(schema)
    src = reader.parquet(f"{d}/events.parquet") if _is_folder(spark, f"{d}/events.parquet") else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    e = src.where("ts is not null and value is not null and event_type is not null").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") + 100.0).alias("price"))
    bars = bars_from_ticks(e, "event_type", "ts", "price", "event_id")
    return _drain(spark, bars, "complete", _fresh(spark, "bars")).select("symbol", F.unix_seconds("timestamp").alias("ts_s"), "open", "high", "low", "close", "volume")


def _streamed(spark: SparkSession, rows: DataFrame, cfg: Pipeline) -> DataFrame:
    """Pattern events of the streaming machine over context rows."""
    base = _fresh(spark, "events")
    rows.write.parquet(f"{base}/in")
    src = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    return _drain(spark, pattern_stream(src, cfg), "append", f"{base}/ev")


def stream_patterns(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Pattern events of the streaming machine."""
    found = _streamed(spark, features.market_context(bars(spark, d), settings(bars)), settings(bars))
    return found.select(*keys, "bar_index", "pattern_type", "start_index", "pullback_bars")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def _fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _drain(spark: SparkSession, stream: DataFrame, mode: str, path: str) -> DataFrame:
    """Run a stream to the end of its input, each batch written (or, in complete mode, written anew) to a folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def stream_equals_batch(spark: SparkSession, d: str, bars: Source = event_bars, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Events that both the stream and the batch operator find, and those that only one of them does."""
    rows = durable(features.market_context(bars(spark, d), settings(bars)))
    cols = [*SERIES, "bar_index", "pattern_type", "start_index", "pullback_bars"]
    batch = patterns.detect(rows, settings(bars)).where("kind = 'event'").select(*cols, F.lit(1).alias("batch"))
    stream = _streamed(spark, rows, settings(bars)).select(*cols, F.lit(2).alias("stream"))
    both = batch.join(stream, cols, "full").withColumn("found", F.coalesce("batch", F.lit(0)) + F.coalesce("stream", F.lit(0)))
    counts = [F.count_if(F.col("found") == k).alias(n) for k, n in ((3, "n_both"), (1, "n_batch_only"), (2, "n_stream_only"))]
    return both.groupBy(*keys, "pattern_type").agg(*counts)


QUERIES = {
    f.__name__: f
    for f in (
        markdown_paragraphs, html_paragraphs, knowledge_chunks, ngram_features, hash_embedding, vector_topk, vector_topk_filtered, passage_retrieval, explanation_prompts,
        sql_parameterized, sql_grouping_sets, sql_set_difference, partition_catalog, manifest_upsert, rule_gate, stream_bars, stream_patterns, stream_equals_batch,
    )
} | {f"ohlcv_{f.__name__}": partial(f, bars=_clean, keys=SERIES) for f in (stream_patterns, stream_equals_batch)}

_MD = r"""
WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS raw, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) AS n FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc, n, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l),
f AS (SELECT *, starts_with(line, '```') OR starts_with(line, '~~~') AS fence FROM t),
g AS (SELECT *, sum(CAST(fence AS INT)) OVER w % 2 = 1 AS inside FROM f WINDOW w AS (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, CASE WHEN NOT inside AND NOT fence AND regexp_matches(line, '^#{1,6}\s+.+$') THEN length(regexp_extract(line, '^(#{1,6})\s', 1)) END AS level FROM g),
c AS (SELECT *, coalesce(last_value(CASE WHEN level <= 2 THEN n END IGNORE NULLS) OVER w, -1) AS top, last_value(CASE WHEN level > 2 THEN n END IGNORE NULLS) OVER w AS sub,
  NOT inside AND NOT fence AND level IS NULL AND line <> '' AS body,
  sum(CASE WHEN NOT inside AND NOT fence AND level IS NULL AND line <> '' THEN 0 ELSE 1 END) OVER w AS block FROM h WINDOW w AS (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING)),
p AS (SELECT doc, top, CASE WHEN sub > top THEN sub END AS sub, block, min(n) AS seq, string_agg(line, ' ' ORDER BY n) AS x FROM c WHERE body GROUP BY ALL),
"""


def _plain(x: str) -> str:
    """SQL of Markdown without its marks, with single spaces."""
    for pattern, by, flags in ((r"^[-*+]\s+", "", ""), (r"^\d+[.)]\s+", "", ""), (r"!\[([^\]]*)\]\([^)]+\)", r"\1", "g"), (r"\[([^\]]+)\]\([^)]+\)", r"\1", "g"), (r"\*\*|__|`|~~", "", "g"), (r"[\s\x{a0}]+", " ", "g")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', '{flags}')"
    return f"trim({x})"


def _title(line: str) -> str:
    return _plain(f"regexp_extract({line}, '^#{{1,6}}\\s+(.+)$', 1)")


def _topk(where: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 {where})
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5"""


ORACLE = {
    "markdown_paragraphs": _MD
    + f"q AS (SELECT doc, top, sub, seq, {_plain('x')} AS text FROM p)"
    + f"""SELECT q.doc, CASE WHEN q.top < 0 THEN 'Front Matter' ELSE {_title('a.line')} END AS chapter, CASE WHEN q.sub IS NOT NULL THEN {_title('b.line')} END AS section,
  row_number() OVER (PARTITION BY q.doc, q.top ORDER BY q.seq) AS paragraph, q.text FROM q LEFT JOIN t a ON a.doc = q.doc AND a.n = q.top LEFT JOIN t b ON b.doc = q.doc AND b.n = q.sub WHERE q.text <> ''""",
    "ngram_features": r"""WITH w AS (SELECT regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:[''\-][A-Za-z0-9]+)*|[\x{3400}-\x{9fff}]') AS w FROM book_paragraphs WHERE text IS NOT NULL),
f AS (SELECT unnest(list_transform(w, lambda x: 'w1:' || x)) AS feature FROM w UNION ALL SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda i: 'w2:' || w[i] || ' ' || w[i + 1])) FROM w)
SELECT feature, count(*) AS n FROM f GROUP BY feature""",
    "vector_topk": _topk(""),
    "vector_topk_filtered": _topk("AND e.label = 0"),
    "sql_parameterized": """SELECT n.n_name, o.o_orderpriority, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 100000 GROUP BY n.n_name, o.o_orderpriority""",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "sql_set_difference": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000",
    "manifest_upsert": "SELECT feed, coalesce(zone_name, 'UTC') AS zone_name, date_order FROM feeds",
    "partition_catalog": _CLEAN + "SELECT symbol, timeframe, count(*) AS n_bars FROM b GROUP BY ALL",
    "stream_bars": _BARS + "SELECT symbol, epoch(timestamp)::BIGINT AS ts_s, open, high, low, close, volume FROM b",
    "stream_patterns": _SETUPS + "SELECT symbol, i AS bar_index, pattern_type, si AS start_index, bars AS pullback_bars FROM e1",
    "stream_equals_batch": _SETUPS + "SELECT symbol, pattern_type, count(*) AS n_both, 0 AS n_batch_only, 0 AS n_stream_only FROM e1 GROUP BY ALL",
    "rule_gate": "SELECT CASE WHEN item_id % 2 = 0 AND lang = 'en' THEN 'approved' ELSE 'candidate' END AS status, count(*) AS n FROM eval_items GROUP BY ALL",
}
ORACLE |= {f"ohlcv_{n}": delivered(ORACLE[n]) for n in ("stream_patterns", "stream_equals_batch")}
