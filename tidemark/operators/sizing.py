"""Position sizing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.plans.panel import by_symbol


def portfolio_vol(positions: DataFrame, lookback: int = 60, per_year: float = 252.0, column: str = "position") -> DataFrame:
    """ts, bar_idx and vol: the rolling deviation of the book's return, known one bar later. positions has `ret`."""
    held = F.lag(column).over(by_symbol())
    book = positions.withColumn("g", held * F.col("ret")).groupBy("ts", "bar_idx").agg(F.sum("g").alias("g"))
    w = Window.orderBy("bar_idx")
    frame = w.rowsBetween(1 - lookback, 0)
    sd = F.when(F.count("g").over(frame) == lookback, F.stddev_samp("g").over(frame))
    return book.withColumn("sd", sd).select("ts", "bar_idx", (F.lag("sd").over(w) * math.sqrt(per_year)).alias("vol"))


def vol_target(positions: DataFrame, target: float = 0.10, lookback: int = 60, max_leverage: float = 3.0, per_year: float = 252.0, column: str = "position") -> DataFrame:
    """Positions scaled to the target volatility, at most max_leverage times; 0 while the volatility is unknown."""
    vol = portfolio_vol(positions, lookback, per_year, column).select("bar_idx", "vol")
    scale = F.coalesce(F.when(F.col("vol") > 0, F.least(ratio(F.lit(target), "vol"), F.lit(max_leverage))), F.lit(0.0))
    return positions.join(vol, "bar_idx", "left").withColumn("scale", scale).withColumn(column, F.col(column) * F.col("scale")).drop("vol")


def kelly(mu: float, sigma: float, fraction: float = 0.25) -> float:
    """The fraction of the growth-optimal bet."""
    return fraction * mu / sigma**2 if sigma > 0 else math.nan
