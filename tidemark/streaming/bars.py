"""Streams: events to bars, bars to the store, and the trade budget as a stateful operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.allocator import DEAD_BAND
from tidemark.sources.store import dated


def windowed_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", symbol: str = "event_type", value: str = "value", seq: str = "event_id") -> DataFrame:
    """Open, high, low, close and volume of tumbling windows; events later than `late` are left out.

    Works on a stream (append mode emits a window when the watermark has passed it)
    and, without the watermark's effect, on a table.
    """
    at = F.struct(ts, seq)
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = timed.groupBy(F.window(ts, width).alias("w"), F.col(symbol).alias("symbol"))
    out = grouped.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(value).alias("volume"))
    return out.select(F.col("w.start").alias("ts"), "symbol", "open", "high", "low", "close", "volume")


def shared_folder(spark) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset, for a local master, one of this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{folder}/stream-{uuid.uuid4().hex}"


def bars_of_stream(bars: DataFrame) -> DataFrame:
    """Run a stream of bars over all input there is and return its table, late events included."""
    spark = bars.sparkSession
    folder = shared_folder(spark)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")

    running = bars.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/log").foreachBatch(replace).start()
    running.awaitTermination()
    done = running.lastProgress
    return spark.read.schema(bars.schema).parquet(f"{folder}/{done['batchId']}" if done else f"{folder}/[0-9]*")


def append_to_store(bars: DataFrame, store_path: str, checkpoint: str):
    """Write a stream of bars to the store, partitioned by session date and symbol as the store itself does, exactly once."""
    return dated(bars, "ts").writeStream.format("parquet").partitionBy("date", "symbol").option("path", store_path).option("checkpointLocation", checkpoint).outputMode("append").start()


def budget_stream(targets: DataFrame, budget: int, cost_bps: float, edge_bps: float = 5.0, dead_band: float = DEAD_BAND) -> DataFrame:
    """The trade budget over a stream: state is each book's positions, its day and the trades left.

    targets: book, ts and `desired`, a map from symbol to target (null: hold),
    one row for each bar; bars of a book must arrive in order.
    """
    edge = edge_bps / 1e4

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names, held, day, left = state.get if state.exists else ([], [], "", budget)
        book, out = dict(zip(names, held)), []
        for row in sorted((r for pdf in batches for r in pdf.itertuples()), key=lambda r: r.ts):
            if str(row.ts.date()) != day:
                day, left = str(row.ts.date()), budget
            wanted = {s: (book.get(s, 0.0) if x is None or np.isnan(x) else float(x)) for s, x in dict(row.desired).items()}
            moves = {s: x - book.get(s, 0.0) for s, x in wanted.items()}
            worth = {s: abs(d) * (edge - cost_bps / 1e4) for s, d in moves.items()}
            ranked = sorted((s for s in moves if abs(moves[s]) > dead_band and worth[s] > 0), key=lambda s: (-worth[s], s))[:left]
            left -= len(ranked)
            book |= {s: book.get(s, 0.0) for s in wanted} | {s: wanted[s] for s in ranked}
            out += [(key[0], row.ts, s, book[s], s in ranked) for s in sorted(wanted)]
        state.update((list(book), [float(x) for x in book.values()], day, left))
        yield pd.DataFrame(out, columns=["book", "ts", "symbol", "position", "executed"])

    return targets.groupBy("book").applyInPandasWithState(
        run, "book string, ts timestamp, symbol string, position double, executed boolean", "names array<string>, held array<double>, day string, budget_left int", "append", "NoTimeout"
    )
