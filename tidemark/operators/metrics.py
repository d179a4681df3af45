"""Performance metrics of return series and the statistics of many trials.

Column metrics are aggregate expressions, so any number of series is measured
in one groupBy; scalars are plain Python.  NaN and infinite returns are undefined, like null.
"""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import col, defined, ratio

EULER = 0.5772156649015329
_NORMAL = statistics.NormalDist()


def sharpe(r: Column | str, per_year: float = 252.0, risk_free: float = 0.0, annual: bool = True) -> Column:
    """Mean over sample deviation of the excess returns; null below two returns or without variation."""
    r = defined(r)
    out = ratio(F.avg(r) - risk_free / per_year, F.stddev_samp(r))
    return out * math.sqrt(per_year) if annual else out


def annualize(x: Column | float, per_year: float = 252.0):
    return x * math.sqrt(per_year)


def deannualize(x: Column | float, per_year: float = 252.0):
    return x / math.sqrt(per_year)


def sortino(r: Column | str, per_year: float = 252.0, target: float = 0.0, annual: bool = True) -> Column:
    """Mean excess over the root mean square shortfall, taken over all returns; null below two."""
    r = defined(r)
    short = F.least(r - target, F.lit(0.0))
    out = F.when(F.count(r) > 1, ratio(F.avg(r - target), F.sqrt(F.avg(F.when(r.isNotNull(), short * short)))))
    return out * math.sqrt(per_year) if annual else out


def hit_rate(r: Column | str) -> Column:
    r = defined(r)
    return ratio(F.count_if(r > 0).cast("double"), F.count_if(r != 0))


def equity(df: DataFrame, r: str = "net", keys: tuple[str, ...] = (), order: str = "ts", compound: bool = True) -> DataFrame:
    """equity, its running peak and drawdown; the peak starts at the first equity point.

    Compounded equity is the product of 1 + r: a bar that loses everything ends it at 0,
    and the drawdown against a peak of 0 is null.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.coalesce(defined(r), F.lit(0.0))
    value = F.product(F.lit(1.0) + zero).over(w) if compound else F.lit(1.0) + F.sum(zero).over(w)
    out = df.withColumn("equity", value).withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", ratio("equity", "peak") - 1 if compound else F.col("equity") - F.col("peak"))


def max_drawdown(df: DataFrame, r: str = "net", keys: tuple[str, ...] = (), order: str = "ts", compound: bool = True) -> DataFrame:
    return equity(df.where(defined(r).isNotNull()), r, keys, order, compound).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def turnover(positions: DataFrame, per_year: float = 252.0, column: str = "position") -> DataFrame:
    """Mean of the rows' summed position changes, the first row excluded, a year."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    moved = positions.withColumn("d", F.abs(F.col(column) - F.lag(column).over(w))).groupBy("bar_idx").agg(F.sum("d").alias("d"))
    return moved.where(F.col("bar_idx") > 0).agg((F.avg("d") * per_year).alias("turnover"))


def kurtosis_pair(r: Column | str) -> tuple[Column, Column]:
    """Unbiased skewness and unbiased kurtosis (normal: 3), from Spark's population moments."""
    r = defined(r)
    n = F.count(r).cast("double")
    skew = F.skewness(r) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    excess = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6)
    return skew, excess + 3


def summary(df: DataFrame, r: str = "net", keys: tuple[str, ...] = (), order: str = "ts", per_year: float = 252.0) -> DataFrame:
    """One row of metrics for each series; n_periods counts rows, null returns included."""
    curve = equity(df, r, keys, order)
    skew, kurt = kurtosis_pair(r)
    last = F.max_by("equity", order)
    out = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.count(defined(r)).alias("n_returns"),
        (F.avg(defined(r)) * per_year).alias("mean_annual"),
        (F.stddev_samp(defined(r)) * math.sqrt(per_year)).alias("vol_annual"),
        sharpe(r, per_year).alias("sharpe"),
        sharpe(r, per_year, annual=False).alias("sharpe_per_period"),
        sortino(r, per_year).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        hit_rate(r).alias("hit_rate"),
        (last - 1).alias("total_return"),
        skew.alias("skew"),
        kurt.alias("kurtosis"),
    )
    years = F.col("n_returns") / per_year
    cagr = F.pow(F.col("total_return") + 1, F.lit(1.0) / years) - 1
    calmar = F.when(F.col("total_return") <= -1, F.lit(float("-inf"))).otherwise(ratio(cagr, F.abs("max_drawdown")))
    return out.withColumn("calmar", F.when(F.col("n_returns") > 1, calmar))


def sharpe_variance(sharpes: list[float]) -> float:
    """Sample variance over the trials' finite Sharpe ratios."""
    own = [x for x in sharpes if math.isfinite(x)]
    return statistics.variance(own) if len(own) > 1 else math.nan


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    """The Sharpe ratio that the best of n_trials reaches by luck."""
    if n_trials <= 1:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * _NORMAL.inv_cdf(1 - 1 / n_trials) + EULER * _NORMAL.inv_cdf(1 - 1 / (n_trials * math.e)))


def probabilistic_sharpe(sr: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    """P(true Sharpe > benchmark), all per period, from the moments that `summary` gives."""
    if n < 4:
        return math.nan
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return _NORMAL.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(spread)) if spread > 0 else math.nan


def deflated_sharpe(sr: float, n: int, skew: float, kurt: float, n_trials: int, variance: float | None = None) -> float:
    """The probabilistic Sharpe ratio at the threshold of luck."""
    return probabilistic_sharpe(sr, n, skew, kurt, expected_max_sharpe(n_trials, 1 / (n - 1) if variance is None else variance))


def normal_two_sided(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2))
