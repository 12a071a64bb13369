"""spark-submit entry points: python -m barkeel.cli COMMAND ..."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib

from pyspark.sql import functions as F

from barkeel import __version__
from barkeel.config import Pipeline, load
from barkeel.operators import execution, patterns, setups, statistics, text, vectors
from barkeel.operators.blocks import indexed
from barkeel.session import durable, local_session
from barkeel.sources import store, vendor


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barkeel")
    parser.add_argument("--version", action="version", version=__version__)
    sub = parser.add_subparsers(dest="command", required=True)
    imp = sub.add_parser("import", help="validate a file and store it")
    for a in ("path", "root", "symbol", "timeframe"):
        imp.add_argument(a)
    imp.add_argument("--unit")
    back = sub.add_parser("backtest", help="replay a stored series")
    for a in ("root", "symbol", "timeframe", "out"):
        back.add_argument(a)
    back.add_argument("--config")
    back.add_argument("--limit", type=int)
    down = sub.add_parser("download", help="request minute bars in chunks and store them")
    for a in ("factory", "chunks", "root", "start", "end"):
        down.add_argument(a)
    down.add_argument("symbols", nargs="+")
    down.add_argument("--pace", type=float, default=11.0)
    sub.add_parser("paper", help="live paper trading is not part of the engine")
    book = sub.add_parser("paragraphs", help="a book (.epub, .md, .markdown) to paragraphs (JSON lines)")
    book.add_argument("book")
    book.add_argument("out")
    ingest = sub.add_parser("ingest", help="paragraphs (JSON lines) to a chunk index")
    ingest.add_argument("paragraphs")
    ingest.add_argument("index")
    ask = sub.add_parser("search", help="best chunks for a text")
    ask.add_argument("index")
    ask.add_argument("query")
    ask.add_argument("--book")
    ask.add_argument("--top-k", type=int, default=0)
    args = parser.parse_args(argv)
    if args.command == "paper":
        print("paper trading is not implemented; use backtest")
        return 2
    spark = local_session()
    cfg = load(args.config) if getattr(args, "config", None) else Pipeline()
    if args.command == "import":
        store.BarStore(spark, args.root).write_series(store.load_ohlcv(spark, args.path, args.unit), args.symbol, args.timeframe, cfg.strategy_version)
    elif args.command == "backtest":
        print(backtest(spark, args, cfg))
    elif args.command == "download":
        print(download(spark, args, cfg))
    elif args.command == "paragraphs":
        found = store.parse_book(spark, args.book)
        store.write_paragraphs(found.orderBy("source_file", "seq").drop("seq"), args.out)
    elif args.command == "ingest":
        paragraphs = store.read_paragraphs(spark, args.paragraphs).withColumn("seq", F.monotonically_increasing_id())
        chunked = durable(text.chunks(paragraphs, "seq", cfg.knowledge))
        store.save_index(chunked, text.embed(chunked, "chunk_id", "text", cfg.knowledge), args.index)
    else:
        search(spark, args.index, args.query, args.top_k or cfg.knowledge.top_k, args.book, cfg).show(truncate=80)
    return 0


def download(spark, args, cfg: Pipeline) -> list:
    """Missing chunks are requested, then all chunks are merged into the store with their coarser timeframes."""
    module, _, function = args.factory.partition(":")
    chunks = store.ChunkStore(spark, args.chunks)
    start, end = dt.datetime.fromisoformat(args.start), dt.datetime.fromisoformat(args.end)
    asked = vendor.download_chunks(chunks, getattr(importlib.import_module(module), function)(), args.symbols, start, end, pace=args.pace)
    store.BarStore(spark, args.root).write_timeframes(chunks.merged(), cfg.strategy_version)
    return asked


def backtest(spark, args, cfg: Pipeline) -> str:
    """Run the pipeline on one stored series and write the experiment."""
    bars = store.BarStore(spark, args.root).read(args.symbol, args.timeframe)
    if args.limit:  # before anything is computed from the bars
        bars = indexed(bars).where(F.col("bar_index") < args.limit).select(*bars.columns)
    rows = durable(setups.spine(bars, cfg))
    accepted = durable(setups.signals(setups.evaluate_setups(patterns.pattern_events(rows, cfg), rows, cfg)))
    trades = durable(execution.trade_log(execution.simulate(rows, accepted, cfg), accepted, cfg))
    metrics = statistics.backtest_metrics(trades, cfg.execution.initial_cash, ["symbol"])
    return store.write_experiment(trades, metrics, args.out, f"{args.symbol}-{args.timeframe}", cfg)


def search(spark, index: str, query: str, k: int, book: str | None, cfg: Pipeline):
    """Best chunks by inner product of hashed vectors; a book filter comes before the ranking."""
    if not query.strip():
        raise ValueError("empty query")
    chunks, vecs = store.load_index(spark, index)
    if book is not None:
        chunks = chunks.where(chunks["book"] == book)
        vecs = vecs.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    asked = text.embed(spark.createDataFrame([("query", query)], "chunk_id string, text string"), "chunk_id", "text", cfg.knowledge)
    best = vectors.top_k(vecs, asked, "chunk_id", "vector", k)
    return best.join(chunks, "chunk_id").orderBy("rank").select("rank", "score", "source_reference", "text")


if __name__ == "__main__":
    raise SystemExit(main())
