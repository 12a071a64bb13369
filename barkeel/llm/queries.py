"""Queries of the problems tagged llm (5, 6, 8, 9 and 10), and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barkeel.llm.leaks import find_leaks
from barkeel.llm.mixing import mix_sources
from barkeel.llm.percentiles import latest_rows, merge_runs, percentiles_of_runs, percentiles_of_summaries, rank_summary, value_runs
from barkeel.llm.pieces import split_items
from barkeel.llm.residue import find_residue, judged, scan
from barkeel.plans.tables import table
from barkeel.session import durable

GROUPS = ["pattern_type", "market_regime"]
MEASURES = ["pnl_r", "mfe_r"]
PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def _trades(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return latest_rows(table(spark, d, "trade_log"), "trade_id", "row_id", [*GROUPS, *MEASURES, *more])


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per pattern and regime."""
    found = percentiles_of_runs(value_runs(_trades(spark, d), GROUPS, MEASURES), GROUPS, PROBS)
    return found.withColumn("percentile", F.round("percentile", 9))


def p5_combined_versions(spark: SparkSession, d: str) -> DataFrame:
    """The same from runs made separately per strategy version (the deliveries) and then added."""
    trades = durable(_trades(spark, d, "strategy_version"))
    late = F.coalesce(F.col("strategy_version") >= "0.7", F.lit(False))
    runs = merge_runs([value_runs(trades.where(late), GROUPS, MEASURES), value_runs(trades.where(~late), GROUPS, MEASURES)], GROUPS)
    return percentiles_of_runs(runs, GROUPS, PROBS).withColumn("percentile", F.round("percentile", 9))


def p5_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Percentile bounds from bounded summaries of two deliveries."""
    trades = durable(_trades(spark, d, "strategy_version"))
    late = F.coalesce(F.col("strategy_version") >= "0.7", F.lit(False))
    parts = [rank_summary(value_runs(trades.where(w), GROUPS, MEASURES), GROUPS) for w in (late, ~late)]
    return percentiles_of_summaries(parts[0].unionByName(parts[1]), GROUPS, PROBS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that had to be cut."""
    return split_items(table(spark, d, "book_paragraphs")).where("pieces > 1 and piece = 1").select("para_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    cols = ["para_id", "book", "chapter", "section", "paragraph", "piece", "pieces", "start", "end", "overlap", "piece_text"]
    return split_items(table(spark, d, "book_paragraphs")).select(*cols)


def p6_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Per row, the digest of its pieces put together again without their overlaps, and how many pieces are too long, out of order or do not overlap as given."""
    p = split_items(table(spark, d, "book_paragraphs"))
    body = F.substring(F.col("piece_text"), F.col("overlap") + 1, F.lit(1 << 30))
    inside = F.struct("piece", body.alias("body"), "start", "end", "pieces", "overlap", F.length("piece_text").alias("size"))
    rows = p.groupBy("para_id").agg(F.sort_array(F.collect_list(inside)).alias("p"))
    wrong = lambda x, i: (x["size"] > 1400) | (x["piece"] != i + 1) | (x["pieces"] != F.size("p")) | (x["overlap"] != F.least(F.lit(100), x["start"])) | (x["start"] != F.coalesce(F.get("p", i - 1)["end"], F.lit(0))) | (x["size"] != x["end"] - x["start"] + x["overlap"])
    return rows.select("para_id", F.md5(F.array_join(F.transform("p", lambda x: x["body"]), "")).alias("digest"), F.size(F.filter("p", wrong)).alias("n_wrong"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leak_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item, how many documents leak it, and how much of it at most."""
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.round(F.max("coverage"), 6).alias("most"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every record with the number of times that it is used."""
    mix, _ = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mix.select(F.col("record_id").alias("doc_id"), "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares per source."""
    _, report = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.withColumn("share", F.round("share", 9))


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the targets with text: tokens within one record of the budget, and no record used too often."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    mix, report = mix_sources(docs, targets)
    mix = durable(mix)
    largest = mix.groupBy("source").agg(F.max("n_tokens").alias("largest"), F.max("copies").alias("most"))
    total = report.agg(F.sum("tokens").alias("all")).first()["all"] or 0
    both = report.where("target_share > 0 and tokens > 0").join(largest, "source").join(targets.groupBy("source").agg(F.max("max_repeats").alias("cap")), "source")
    slack = both.agg(F.sum("largest")).first()[0] or 0  # one row per source
    near = F.abs(F.col("tokens") - F.col("target_share") * total) <= F.col("largest") + F.col("target_share") * slack
    return both.select("source", near.alias("within"), (F.col("most") <= F.col("cap")).alias("capped"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents")).select("doc_id")


def p10_templates(spark: SparkSession, d: str) -> DataFrame:
    """Mined templates with a verdict: what decided it, distinct messages, documents, and how many of these hold another seeded template."""
    templates, _ = judged(durable(scan(table(spark, d, "documents"))))
    return templates.select("kind", "why", "template", F.col("forms").alias("n_messages"), F.col("docs").alias("n_docs"), F.col("accompanied").alias("n_accompanied"))


QUERIES = {f.__name__: f for f in (p5_percentiles, p5_combined_versions, p5_bounds, p6_found, p6_pieces, p6_rejoined, p8_found, p8_leak_report, p9_mix, p9_shares, p9_check, p10_found, p10_templates)}

_P5 = """
WITH t AS (SELECT pattern_type, market_regime, pnl_r, mfe_r FROM trade_log QUALIFY trade_id IS NULL OR row_number() OVER (PARTITION BY trade_id ORDER BY row_id DESC) = 1),
m AS (SELECT pattern_type, market_regime, 'pnl_r' AS measure, pnl_r AS v FROM t UNION ALL SELECT pattern_type, market_regime, 'mfe_r', mfe_r FROM t),
q AS (SELECT pattern_type, market_regime, measure, count(*) AS n_values, quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM m WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL)
SELECT pattern_type, market_regime, measure, n_values, unnest([0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95]) AS p, round(unnest(q), 9) + 0.0 AS percentile, 0 AS rank_error FROM q
"""

ORACLE = {
    "p5_percentiles": _P5,
    "p5_combined_versions": _P5,
    "p6_rejoined": "SELECT para_id, md5(text) AS digest, 0 AS n_wrong FROM book_paragraphs WHERE text IS NOT NULL",
    "p9_check": "SELECT DISTINCT source, true AS within, true AS capped FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE text <> '') AND target_share > 0",
    "p6_found": "SELECT para_id FROM book_paragraphs WHERE length(text) > 1400",
}
