"""Backtests net of costs."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.plans.panel import simple_returns

MIN_TRADE = 1e-4


def check_symbols(prices: DataFrame, positions: DataFrame) -> None:
    """No common symbol is an error, a symbol without prices a warning."""
    have, want = (df.select("symbol").distinct() for df in (prices, positions))
    missing = want.join(have, "symbol", "left_anti").count()
    if missing and not want.join(have, "symbol", "left_semi").limit(1).count():
        raise ValueError("prices and positions have no symbol in common")
    if missing:
        warnings.warn(f"{missing} symbols of the positions have no prices", stacklevel=2)


def asset_backtest(panel: DataFrame, column: str = "signal", cost_bps: float = 1.0, lag: int = 1, warmup: int = 0, keys: tuple[str, ...] = (), charge_entry: bool = False) -> DataFrame:
    """held, gross, turnover, cost and net of every cell.

    The target of a bar is held `lag` bars later; warm-up bars are trimmed
    after all differences.  A position that is entered from null costs
    nothing unless charge_entry is set.
    """
    if lag < 1:
        raise ValueError("lag must be at least 1")
    w = Window.partitionBy(*keys, "symbol").orderBy("bar_idx")
    out = panel if "ret" in panel.columns else simple_returns(panel)
    out = out.withColumn("held", F.lag(column, lag).over(w))
    before = F.lag("held").over(w)
    out = out.withColumn("gross", F.col("held") * F.col("ret")).withColumn("turnover", F.abs(F.col("held") - (F.coalesce(before, F.lit(0.0)) if charge_entry else before)))
    out = out.withColumn("cost", F.col("turnover") * cost_bps / 1e4).withColumn("net", F.col("gross") - F.coalesce("cost", F.lit(0.0)))
    return out.where(F.col("bar_idx") >= warmup) if warmup else out


def backtest(panel: DataFrame, column: str = "signal", cost_bps: float = 1.0, lag: int = 1, warmup: int = 0, keys: tuple[str, ...] = (), charge_entry: bool = False, min_trade: float = MIN_TRADE) -> DataFrame:
    """The book by bar: gross, cost, turnover, trades and net; sums over symbols, null where none is defined."""
    cells = asset_backtest(panel, column, cost_bps, lag, warmup, keys, charge_entry)
    book = cells.groupBy(*keys, "ts", "bar_idx").agg(
        F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum("turnover").alias("turnover"), F.count_if(F.col("turnover") > min_trade).alias("trades")
    )
    return book.withColumn("net", F.col("gross") - F.coalesce("cost", F.lit(0.0)))


def daily_trades(book: DataFrame) -> DataFrame:
    return book.groupBy(F.to_date("ts").alias("day")).agg(F.sum("trades").alias("trades"))


def ledger(books: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """The summary of every book, best Sharpe ratio first."""
    totals = books.groupBy(*keys).agg(F.sum("cost").alias("total_cost"), F.avg("turnover").alias("mean_turnover"))
    return metrics.summary(books, "net", keys).join(totals, list(keys)).orderBy(F.col("sharpe").desc_nulls_last(), *keys)


def regime_verdict(conditional: float, fixed: float, n_strategies: int, n_regimes: int, n_periods: int) -> dict:
    """Whether the uplift of conditioning (annual Sharpe ratios) beats the extra luck that it buys."""
    luck = [metrics.expected_max_sharpe(n, 1 / max(n_periods - 1, 1)) * math.sqrt(252) for n in (n_strategies, n_strategies * n_regimes)]
    uplift, extra = conditional - fixed, luck[1] - luck[0]
    return {"uplift": uplift, "extra_luck": extra, "justified": uplift > extra}


def round_trips(cells: DataFrame, limit: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of one sign of the held position by symbol: opened, closed, bars, side and P&L (held times return), newest first."""
    w = Window.partitionBy(*keys, "symbol").orderBy("bar_idx")
    side = F.signum(F.coalesce("held", F.lit(0.0)))
    runs = cells.withColumn("side", side).withColumn("_c", (~F.col("side").eqNullSafe(F.lag("side").over(w))).cast("int")).withColumn("_run", F.sum("_c").over(w))
    out = runs.where("side <> 0").groupBy(*keys, "symbol", "_run", "side").agg(
        F.min("ts").alias("opened"), F.max("ts").alias("closed"), F.count(F.lit(1)).alias("bars"), F.sum("gross").alias("pnl"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost")
    ).drop("_run")
    return out.orderBy(F.col("closed").desc(), "symbol").limit(limit) if limit else out
