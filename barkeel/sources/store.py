"""Partitioned bar store, loaders, experiments and their catalogues."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barkeel.config import Pipeline
from barkeel.operators import sessions, text, validate
from barkeel.operators.blocks import SERIES
from barkeel.session import durable

_SAFE = re.compile(r"[A-Za-z0-9_.\-]+")
OHLCV = "timestamp timestamp, open double, high double, low double, close double, volume double"

# Columns of the trade log and of the statistics table.
TRADE_LOG = (
    "trade_id string, symbol string, timeframe string, setup string, pattern_type string, direction string, market_regime string, pattern_score double, context_score double, "
    "signal_body_ratio double, signal_close_location double, ema_slope_ratio double, volatility_range_ratio double, entry_time timestamp, entry_price double, quantity double, "
    "point_value double, slippage_ticks int, stop_price double, target_price double, exit_time timestamp, exit_price double, initial_risk double, gross_pnl double, pnl double, "
    "commission double, pnl_r double, mfe double, mae double, mfe_r double, mae_r double, bars_held int, signal_bar_index bigint, market_state string, pattern_metadata string, "
    "entry_reason string, exit_reason string, strategy_version string"
)
STATISTICS = (
    "symbol string, timeframe string, strategy_version string, scope string, pattern_type string, market_regime string, signal_bar_quality string, ema_slope_bucket string, "
    "session string, volatility_regime string, total bigint, wins bigint, losses bigint, breakevens bigint, win_rate double, probability_win double, avg_win_r double, avg_loss_r double, "
    "avg_r double, expectancy_r double, profit_factor double, max_drawdown double, median_mfe double, median_mae double, median_mfe_r double, median_mae_r double"
)


def safe(value: str) -> str:
    """A value that may stand in a partition path."""
    if not _SAFE.fullmatch(value):
        raise ValueError(f"unsafe partition value: {value!r}")
    return value


def load_ohlcv(spark: SparkSession, path: str, unit: str | None = None, renames: Mapping[str, str] | None = None) -> DataFrame:
    """A CSV or Parquet file in strict canonical form."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
        digits = raw.where(~F.col(next(c for c in raw.columns if c.strip().lower() == "timestamp")).rlike(r"^\s*\d+\s*$")).isEmpty() if any(c.strip().lower() == "timestamp" for c in raw.columns) else False
        if digits:
            name = next(c for c in raw.columns if c.strip().lower() == "timestamp")
            raw = raw.withColumn(name, F.col(name).try_cast("bigint"))
    elif low.endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown file type: {path}")
    return validate.normalize(raw, renames, unit)


class BarStore:
    """Bars under root/symbol=…/timeframe=…; a write replaces the partitions that it holds."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, symbol: str, timeframe: str) -> str:
        return f"{self.root}/symbol={safe(symbol)}/timeframe={safe(timeframe)}"

    def write(self, bars: DataFrame, version: str, metadata: Mapping[str, str] | None = None) -> None:
        """Write valid bars that have series columns; provenance goes into the timestamp column's metadata.

        The partitions that the bars touch are replaced when the job commits, not
        before.  A series is spread over its years, so none is a single task.
        """
        bars = durable(bars)  # judged and written from the same rows
        unsafe = ~F.col("symbol").rlike(f"^{_SAFE.pattern}$") | ~F.col("timeframe").rlike(f"^{_SAFE.pattern}$")
        bad = bars.where(F.coalesce(unsafe, F.lit(True))).select(*SERIES).limit(1).collect()
        if bad:
            raise ValueError(f"unsafe partition value: {bad[0]}")
        require_bars(bars)
        facts = {"schema": "ohlcv-v1", "strategy_version": version, **(metadata or {})}
        out = bars.withMetadata("timestamp", facts).repartition(*SERIES, F.year("timestamp")).sortWithinPartitions(*SERIES, "timestamp")
        out.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*SERIES).mode("overwrite").parquet(self.root)

    def write_series(self, bars: DataFrame, symbol: str, timeframe: str, version: str, metadata: Mapping[str, str] | None = None) -> None:
        safe(symbol), safe(timeframe)
        self.write(bars.withColumns({"symbol": F.lit(symbol), "timeframe": F.lit(timeframe)}), version, metadata)

    def read(self, symbol: str | None = None, timeframe: str | None = None) -> DataFrame:
        """Stored bars; given values prune partitions."""
        df = self.spark.read.schema(f"{OHLCV}, symbol string, timeframe string").parquet(self.root)
        for name, value in (("symbol", symbol), ("timeframe", timeframe)):
            if value is not None:
                df = df.where(F.col(name) == safe(value))
        return df

    def read_checked(self, symbol: str | None = None, timeframe: str | None = None) -> DataFrame:
        """Stored bars that are judged again before they are handed out."""
        df = self.read(symbol, timeframe)
        require_bars(df)
        return df

    def metadata(self) -> dict:
        return self.spark.read.parquet(self.root).schema["timestamp"].metadata

    def datasets(self) -> DataFrame:
        """Stored series, in order."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.root)  # paths only, no bars
        return found.select(*SERIES).distinct().orderBy(*SERIES)

    def write_timeframes(self, minute_bars: DataFrame, version: str, minutes: Sequence[int] = (5, 15, 30)) -> DataFrame:
        """Minute bars and their coarser timeframes in one write; returns counts."""
        every = minute_bars
        for n in minutes:
            every = every.unionByName(sessions.resample(minute_bars, n).drop("session_date"))
        self.write(every, version)
        return self.read().groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_bars"))


def merge_chunks(chunks: DataFrame, rank: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """One bar per (series, timestamp) from overlapping chunks: the one with the largest rank; optional range of session dates."""
    one = validate.keep_last(chunks, rank)
    day = F.to_date(F.from_utc_timestamp("timestamp", sessions.ZONE))
    if start is not None:
        one = one.where(day >= F.lit(start))
    if end is not None:
        one = one.where(day <= F.lit(end))
    return one


def require_bars(bars: DataFrame) -> None:
    """Rows that are no bars, and doubled keys, are an error that names up to ten."""
    first = validate.split_valid(bars)[1].limit(10).collect()
    if first:
        raise validate.InvalidBars(f"invalid rows: {[r.asDict() for r in first]}")
    twice = validate.duplicates(bars).limit(10).collect()
    if twice:
        raise validate.InvalidBars(f"duplicate timestamps: {[r.asDict() for r in twice]}")


class ChunkStore:
    """Requested stretches of bars under root/symbol=…/source=(end or repair)/day=…, each with what was requested.

    A repair supersedes the chunks of the regular download.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, symbol: str, day: dt.date, repair: bool = False) -> str:
        return f"{self.root}/symbol={safe(symbol)}/source={'repair' if repair else 'end'}/day={day:%Y-%m-%d}"

    def has(self, symbol: str, day: dt.date, repair: bool = False) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(symbol, day, repair)}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def write(self, bars: DataFrame, symbol: str, day: dt.date, request: Mapping[str, str], repair: bool = False) -> None:
        """One chunk; the request goes into the timestamp column's metadata, and the chunk counts once its write has ended."""
        facts = {"schema": "ohlcv-chunk-v1", **request}
        rows = bars.drop("symbol").withMetadata("timestamp", facts).sort("timestamp")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(self.path(symbol, day, repair))

    def request(self, symbol: str, day: dt.date, repair: bool = False) -> dict:
        return self.spark.read.parquet(self.path(symbol, day, repair)).schema["timestamp"].metadata

    def merged(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """One bar per (series, timestamp): a repair's, else that of the latest chunk."""
        rows = self.spark.read.schema(f"timeframe string, {OHLCV}, symbol string, source string, day date").parquet(self.root)
        ranked = rows.withColumn("rank", F.struct(F.col("source") == "repair", "day"))
        return merge_chunks(ranked, "rank", start, end).drop("rank", "source", "day")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes``, and those of ``table`` whose keys it does not have."""
    return table.join(changes, list(keys), "left_anti").unionByName(changes)


def write_manifest(table: DataFrame, changes: DataFrame, keys: Sequence[str], path: str) -> None:
    """A small table after an upsert, as JSON lines in the order of its keys."""
    upsert(table, changes, keys).coalesce(1).sortWithinPartitions(*keys).write.mode("overwrite").json(path)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, typed and in its order: missing ones are null, others dropped."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted))


def write_trade_log(trades: DataFrame, path: str) -> None:
    """All columns of the trade log, typed; without trades an empty table of the same columns."""
    conform(trades, TRADE_LOG).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_statistics(statistics: DataFrame, path: str) -> None:
    """All columns of the statistics, typed and nullable; without rows an empty table of the same columns."""
    conform(statistics, STATISTICS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_trade_log(spark: SparkSession, path: str) -> DataFrame:
    return read_tolerant(spark, path, TRADE_LOG).orderBy("entry_time", "trade_id")


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return read_tolerant(spark, path, STATISTICS)


def write_experiment(trades: DataFrame, metrics: DataFrame, root: str, label: str, cfg: Pipeline) -> str:
    """A new partition experiment=<id> with trades and one metadata row; the id is never reused."""
    slug = re.sub(r"[^a-z0-9]+", "-", label.lower()).strip("-")[:100] or "run"
    name = f"{slug}_{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%SZ}_{uuid.uuid4().hex[:8]}"
    base = root.rstrip("/")
    trades.write.mode("errorifexists").option("compression", "zstd").parquet(f"{base}/trades/experiment={name}")
    facts = metrics.select(F.to_json(F.struct(*metrics.columns)).alias("metrics")).withColumn("config", F.lit(json.dumps(cfg, default=lambda o: o.__dict__, sort_keys=True)))
    facts.coalesce(1).write.mode("errorifexists").json(f"{base}/metadata/experiment={name}")
    return name


def experiments(spark: SparkSession, root: str) -> DataFrame:
    """Experiments, latest id first; rows that are no JSON are skipped."""
    df = spark.read.schema("metrics string, config string, experiment string").option("mode", "DROPMALFORMED").json(f"{root.rstrip('/')}/metadata")
    return df.orderBy(F.col("experiment").desc())


def artifacts(spark: SparkSession, root: str) -> list[str]:
    """Folders of trades: the default result first if there is one, then experiments, latest id first."""
    base = f"{root.rstrip('/')}/trades"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()]
    runs = sorted((n for n in names if n.startswith("experiment=")), reverse=True)
    return [f"{base}/{n}" for n in [n for n in names if n == "default"] + runs]


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table in the wanted columns: missing ones are null, others dropped, a missing table is empty."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return conform(spark.read.parquet(path), schema)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_paragraphs(paragraphs: DataFrame, path: str) -> None:
    paragraphs.write.mode("overwrite").json(path)


PARAGRAPH = "book string, chapter string, section string, paragraph int, text string, source_file string, source_document string"


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Text lines of one source with their number from 1: counts per partition, then places inside it."""
    kept = durable(lines.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"), "value"))
    counts = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = counts.select("_p", "_first", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row per partition
    return kept.join(before, "_p").select((F.col("_before") + F.col("_i") - F.col("_first") + 1).alias("line"), "value")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of JSON lines; blank lines are skipped, broken ones are an error that names their numbers, and so is an empty file."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{PARAGRAPH}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    wrong = lambda p: p["_bad"].isNotNull() | p["book"].isNull() | p["chapter"].isNull() | p["paragraph"].isNull() | p["text"].isNull()
    rows = lines.select(parsed.alias("p"))
    if not rows.where(wrong(F.col("p"))).isEmpty():
        numbered = numbered_lines(spark.read.text(path)).where(F.trim("value") != "").withColumn("p", parsed)
        first = [r[0] for r in numbered.where(wrong(F.col("p"))).select("line").orderBy("line").limit(10).collect()]
        raise ValueError(f"broken paragraphs in {path}, lines {first}")
    if rows.isEmpty():
        raise ValueError(f"no paragraphs in {path}")
    return rows.select("p.*").drop("_bad")


def parse_book(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of a book file by its extension: .epub, .md or .markdown."""
    low = path.lower()
    if low.endswith(".epub"):
        return text.epub_paragraphs(spark.read.format("binaryFile").load(path))
    if low.endswith((".md", ".markdown")):
        one = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("source_file"), F.col("value").alias("text"))
        return text.markdown_paragraphs(one, book=F.regexp_replace("source_file", r"\.[A-Za-z]+$", ""))
    raise ValueError(f"unknown book type: {path}")


def _content_digest(df: DataFrame) -> Column:
    """A hash of all rows of a table that no order changes."""
    whole = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(whole, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws("-", *parts), 256)


def index_digest(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts and digests of everything in an index: texts and references as well as vectors."""
    count = F.count(F.lit(1))
    return chunks.agg(count.alias("n_chunks"), _content_digest(chunks).alias("chunks")).crossJoin(vectors.agg(count.alias("n_vectors"), _content_digest(vectors).alias("vectors")))  # one row each


def save_index(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Chunks, vectors and, last of all, the manifest with the digests."""
    base = path.rstrip("/")
    chunks.write.mode("overwrite").parquet(f"{base}/chunks")
    vectors.write.mode("overwrite").parquet(f"{base}/vectors")
    read = chunks.sparkSession.read.parquet
    index_digest(read(f"{base}/chunks"), read(f"{base}/vectors")).coalesce(1).write.mode("overwrite").json(f"{base}/manifest")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and vectors that agree with the manifest and with each other."""
    base = path.rstrip("/")
    chunks, vectors = spark.read.parquet(f"{base}/chunks"), spark.read.parquet(f"{base}/vectors")
    want, have = spark.read.json(f"{base}/manifest").first(), index_digest(chunks, vectors).first()
    wrong = [c for c in ("n_chunks", "chunks", "n_vectors", "vectors") if want[c] != have[c]]
    if wrong:
        raise ValueError(f"the index does not match its manifest: {wrong}")
    if have["n_chunks"] != have["n_vectors"] or not chunks.join(vectors, "chunk_id", "left_anti").isEmpty():
        raise ValueError("vectors do not match the chunks")
    return chunks, vectors


def gated_rules(rules: DataFrame) -> DataFrame:
    """Rules with approved only where reviewer, time and a verified source are given; doubled names are an error."""
    twice = rules.groupBy(F.lower(F.trim("name")).alias("name")).count().where("count > 1").limit(10).collect()
    if twice:
        raise ValueError(f"duplicate rule names: {[r['name'] for r in twice]}")
    ok = (F.col("status") == "approved") & F.col("reviewer").isNotNull() & F.col("reviewed_at").isNotNull() & F.coalesce(F.col("source_verified"), F.lit(False))
    return rules.withColumn("status", F.when(F.col("status") != "approved", F.col("status")).when(ok, "approved").otherwise("candidate"))
