"""Regime labels of the market (the equal-weight mean of all symbols), causal at every bar."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.plans.panel import by_symbol, full, log_returns, trailing

MIN_PERIODS = 126
UNCONDITIONAL = "unconditional"
VOL_LABELS, TREND_LABELS, SIGN_LABELS = ("low_vol", "normal_vol", "high_vol"), ("chop", "trend"), ("ac+", "ac-")
#: Above so many rows of a series, expanding quantiles are taken by sorted insertion.
EXACT_ROWS = 5000


def market_series(df: DataFrame, column: str) -> DataFrame:
    """ts, bar_idx and the mean over symbols that have a value."""
    return df.groupBy("ts", "bar_idx").agg(F.avg(column).alias(column))


def realized_vol(panel: DataFrame, window: int = 20, per_year: float = 252.0) -> DataFrame:
    w = trailing(window)
    vol = full(F.stddev_samp("lret").over(w), "lret", w, window) * F.sqrt(F.lit(per_year))
    return log_returns(panel).withColumn("vol", vol)


def efficiency_ratio(panel: DataFrame, window: int = 20) -> DataFrame:
    """|sum of log returns| over the sum of their sizes, averaged over symbols."""
    w, r = trailing(window), F.col("lret")
    er = full(ratio(F.abs(F.sum(r).over(w)), F.sum(F.abs(r)).over(w)), r, w, window)
    return market_series(log_returns(panel).withColumn("er", er), "er")


def autocorrelation(panel: DataFrame, window: int = 60) -> DataFrame:
    """Rolling correlation of a log return with the one before, averaged over symbols."""
    w = trailing(window)
    pairs = log_returns(panel).withColumn("r1", F.lag("lret").over(by_symbol()))
    both = F.when(F.col("lret").isNotNull() & F.col("r1").isNotNull(), 1)
    ac = F.when(F.count(both).over(w) == window, F.corr("lret", "r1").over(w))
    return market_series(pairs.withColumn("ac", F.nanvl(ac, F.lit(None).cast("double"))), "ac")


def expanding_quantiles(series: DataFrame, column: str, quantiles: list[float], min_periods: int) -> DataFrame:
    """q0, q1, ...: linear-interpolated quantiles of all defined values so far, null before min_periods of them.

    A short series uses SQL's percentile over a growing frame, whose cost is
    about quadratic; a long one a single pass with sorted insertion.
    """
    if series.count() <= EXACT_ROWS:
        w = Window.orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
        enough = F.count(column).over(w) >= min_periods
        return series.withColumns({f"q{i}": F.when(enough, F.percentile(column, F.lit(q)).over(w)) for i, q in enumerate(quantiles)})

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        import bisect

        pdf = pdf.sort_values("bar_idx")
        seen: list[float] = []
        out = np.full((len(pdf), len(quantiles)), np.nan)
        for i, x in enumerate(pdf[column].to_numpy()):
            if not np.isnan(x):
                bisect.insort(seen, x)
            if len(seen) >= min_periods:
                for j, q in enumerate(quantiles):
                    at = q * (len(seen) - 1)
                    k = int(at)
                    out[i, j] = seen[k] + (at - k) * (seen[min(k + 1, len(seen) - 1)] - seen[k])
        for j in range(len(quantiles)):
            pdf[f"q{j}"] = out[:, j]
        return pdf

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in series.schema), *(f"q{j} double" for j in range(len(quantiles)))])
    out = series.groupBy().applyInPandas(run, schema)
    return out.withColumns({f"q{j}": F.nanvl(f"q{j}", F.lit(None).cast("double")) for j in range(len(quantiles))})


def vol_regime(panel: DataFrame, window: int = 20, quantiles: tuple[float, float] = (0.33, 0.67), min_periods: int = MIN_PERIODS, per_year: float = 252.0) -> DataFrame:
    """low_vol, normal_vol or high_vol: market volatility against its own past; both cuts are inclusive and high wins."""
    vol = market_series(realized_vol(panel, window, per_year), "vol")
    label = F.when(F.col("vol") >= F.col("q1"), "high_vol").when(F.col("vol") <= F.col("q0"), "low_vol").when(F.col("vol").isNotNull() & F.col("q0").isNotNull(), "normal_vol")
    return expanding_quantiles(vol, "vol", list(quantiles), min_periods).withColumn("regime", label).select("ts", "bar_idx", "regime")


def trend_regime(panel: DataFrame, window: int = 20, quantile: float = 0.5, min_periods: int = MIN_PERIODS) -> DataFrame:
    er = expanding_quantiles(efficiency_ratio(panel, window), "er", [quantile], min_periods)
    return er.select("ts", "bar_idx", F.when(F.col("er") >= F.col("q0"), "trend").when(F.col("er") < F.col("q0"), "chop").alias("regime"))


def classify(panel: DataFrame, tier: int = 0, vol_window: int = 20, trend_window: int = 20, autocorr_window: int = 60, min_periods: int = MIN_PERIODS, allow_tier3: bool = False) -> DataFrame:
    """ts, bar_idx and regime: 0 one label, 1 volatility, 2 trend or chop, 3 both and the sign of autocorrelation."""
    if tier == 0:
        return panel.select("ts", "bar_idx").distinct().withColumn("regime", F.lit(UNCONDITIONAL))
    if tier == 1:
        return vol_regime(panel, vol_window, min_periods=min_periods)
    if tier == 2:
        return trend_regime(panel, trend_window, min_periods=min_periods)
    if tier != 3:
        raise ValueError("tier must be 0, 1, 2 or 3")
    if not allow_tier3:
        raise ValueError("tier 3 has 12 regimes and must be asked for with allow_tier3")
    vol = vol_regime(panel, vol_window, min_periods=min_periods).withColumnRenamed("regime", "v")
    trend = trend_regime(panel, trend_window, min_periods=min_periods).select("bar_idx", F.col("regime").alias("t"))
    ac = autocorrelation(panel, autocorr_window).select("bar_idx", F.when(F.col("ac") >= 0, "ac+").when(F.col("ac") < 0, "ac-").alias("a"))
    every = F.col("v").isNotNull() & F.col("t").isNotNull() & F.col("a").isNotNull()
    return vol.join(trend, "bar_idx").join(ac, "bar_idx").select("ts", "bar_idx", F.when(every, F.concat_ws("|", "v", "t", "a")).alias("regime"))


def sample_counts(labels: DataFrame) -> DataFrame:
    """regime, n, share of labelled bars and the standard error of an annual Sharpe ratio, sqrt(252 / n)."""
    n = F.count(F.lit(1))
    total = F.sum(n).over(Window.partitionBy())
    return labels.where("regime IS NOT NULL").groupBy("regime").agg(n.alias("n"), (n / total).alias("share"), F.sqrt(F.lit(252.0) / n).alias("sharpe_se"))


def bands(labels: DataFrame) -> DataFrame:
    """Runs of equal labels: regime, first and last timestamp, bars."""
    w = Window.orderBy("bar_idx")
    changed = F.when(F.col("regime").eqNullSafe(F.lag("regime").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = labels.withColumn("c", changed).withColumn("band", F.sum("c").over(w))
    return runs.groupBy("band", "regime").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("bars"))


def hypothesis_cost(n_strategies: int, n_regimes: int, n_periods: int) -> dict[str, float]:
    """What testing every strategy in every regime does to the Sharpe ratio that luck alone reaches (annual)."""
    from tidemark.operators.metrics import expected_max_sharpe

    one, many = (expected_max_sharpe(n, 1 / (n_periods - 1)) * math.sqrt(252) for n in (n_strategies, n_strategies * n_regimes))
    return {"threshold_unconditional": one, "threshold_conditional": many, "multiplier": many / one if one else math.nan, "sharpe_se_per_regime": math.sqrt(252 / (n_periods / n_regimes))}


