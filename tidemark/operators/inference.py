"""Information coefficients of signal panels, with standard errors that hold under dependence.

A table of cells has `signal` and `fwd` for each ts, bar_idx, symbol, and any
key columns; each combination of keys is measured on its own, all in one plan.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import defined, ratio
from tidemark.plans.panel import by_symbol

#: Above so many lags, autocovariances are taken by FFT: the join copies every period once a lag.
LAGS = 50


def demean(df: DataFrame, column: str = "fwd", keys: tuple[str, ...] = ()) -> DataFrame:
    """The column less its mean over symbols at each timestamp."""
    return df.withColumn(column, F.col(column) - F.avg(column).over(Window.partitionBy(*keys, "ts")))


def rolling_beta_residual(panel: DataFrame, window: int = 390, min_periods: int | None = None) -> DataFrame:
    """ret less its beta to the market, both taken over the rows before; null before min_periods of them."""
    min_periods = window // 2 if min_periods is None else min_periods
    with_market = panel.withColumn("market", F.avg("ret").over(Window.partitionBy("ts")))
    w = by_symbol().rowsBetween(-window, -1)
    both = F.when(F.col("ret").isNotNull() & F.col("market").isNotNull(), 1)
    x, y = (F.when(F.col("ret").isNotNull() & F.col("market").isNotNull(), F.col(c)) for c in ("market", "ret"))
    beta = F.when(F.count(both).over(w) >= min_periods, ratio(F.covar_samp(x, y).over(w), F.var_samp(x).over(w)))
    return with_market.withColumn("beta", beta).withColumn("resid", F.col("ret") - F.col("beta") * F.col("market"))


def pairwise_correlation(df: DataFrame, column: str = "ret") -> DataFrame:
    """a, b and corr of all pairs of symbols a < b, over their common timestamps.

    The result is a matrix of the symbols, which a breadth estimate needs whole;
    the number of symbols, not of rows, bounds it.
    """
    x = df.where(F.col(column).isNotNull()).select("ts", F.col("symbol").alias("a"), F.col(column).alias("x"))
    y = x.select("ts", F.col("a").alias("b"), F.col("x").alias("y"))
    return x.join(y, "ts").where("a < b").groupBy("a", "b").agg(F.when(F.count(F.lit(1)) > 1, F.corr("x", "y")).alias("corr"))


def breadth(df: DataFrame, column: str = "ret") -> DataFrame:
    """Mean pairwise correlation and the effective number of symbols n / (1 + (n - 1) rho)."""
    n = df.select("symbol").distinct().agg(F.count(F.lit(1)).cast("double").alias("n"))
    rho = pairwise_correlation(df, column).agg(F.avg(F.nanvl("corr", F.lit(None).cast("double"))).alias("rho"))
    return n.join(F.broadcast(rho)).select("n", "rho", (F.col("n") / (1 + (F.col("n") - 1) * F.col("rho"))).alias("n_eff"))  # one row each


def newey_west(series: DataFrame, column: str, lags: int, keys: tuple[str, ...] = (), order: str = "bar_idx") -> DataFrame:
    """se: the Newey-West standard error of the mean of each series (Bartlett weights), and n.

    Null values are dropped first, so lags count defined rows.  A long-run variance
    that isn't positive gives the standard error of independent values.
    """
    own = series.where(F.col(column).isNotNull()).select(*keys, order, F.col(column).alias("x"))
    w = Window.partitionBy(*keys)
    own = own.withColumn("n", F.count("x").over(w)).withColumn("e", F.col("x") - F.avg("x").over(w)).withColumn("k", F.row_number().over(w.orderBy(order)))
    own = own.select(*keys, "n", "e", "k")
    ahead = own.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("e").alias("e1"), F.col("k").alias("k1"))
    pairs = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")).withColumn("k1", F.col("k") + F.col("lag"))
    for c in keys:
        pairs = pairs.withColumn(f"_{c}", F.col(c))
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2.0 * (1 - F.col("lag") / (lags + 1.0)))
    total = pairs.join(ahead, [f"_{c}" for c in keys] + ["k1"]).groupBy(*keys).agg(
        F.sum(weight * F.col("e") * F.col("e1")).alias("lrv"), F.sum(F.when(F.col("lag") == 0, F.col("e") * F.col("e"))).alias("g0"), F.max("n").alias("n")
    )
    n = F.col("n").cast("double")
    se = F.when(F.col("lrv") > 0, F.sqrt(F.col("lrv") / n / n)).otherwise(F.sqrt(ratio(F.col("g0"), n - 1) / n))
    return total.select(*keys, "n", se.alias("se"))


def newey_west_fft(series: DataFrame, column: str, lags: int, keys: tuple[str, ...] = (), order: str = "bar_idx") -> DataFrame:
    """The same by FFT, one task for each series: for series whose pairs would be too many to join."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[column].dropna().to_numpy()
        n = len(x)
        e = x - x.mean()
        f = np.fft.rfft(e, 1 << (2 * max(n, 1)).bit_length())
        cov = np.fft.irfft(f * np.conj(f))[: min(lags, n - 1) + 1]
        weight = 1 - np.arange(len(cov)) / (lags + 1.0)
        lrv = cov[0] + 2 * (weight[1:] * cov[1:]).sum()
        se = math.sqrt(lrv) / n if lrv > 0 else math.sqrt(cov[0] / (n - 1) / n)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), n, se]], columns=[*keys, "n", "se"])

    kinds = "".join(f"{k} {series.schema[k].dataType.simpleString()}, " for k in keys)
    own = series.where(F.col(column).isNotNull()).select(*keys, order, column)
    return own.groupBy(*keys).applyInPandas(run, kinds + "n long, se double")


def newey_west_panel(products: DataFrame, lags: int, column: str = "x", keys: tuple[str, ...] = ()) -> DataFrame:
    """se of the pooled mean from each symbol's own autocovariances (FFT over its rows, gaps as 0), which never lower the variance.

    Symbols of at most max(lags + 2, 10) values are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        x = pdf[column].to_numpy(dtype=float)
        there = ~np.isnan(x)
        n = int(there.sum())
        out = [*(pdf[k].iloc[0] for k in keys), n, np.nan]
        if n > max(lags + 2, 10):
            at = (pdf["bar_idx"] - pdf["bar_idx"].iloc[0]).to_numpy()
            e = np.zeros(int(at[-1]) + 1)
            e[at[there]] = x[there] - x[there].mean()
            f = np.fft.rfft(e, 1 << (2 * len(e)).bit_length())
            cov = np.fft.irfft(f * np.conj(f))[: lags + 1] / n
            weight = 1 - np.arange(len(cov)) / (lags + 1.0)
            out[-1] = max(cov[0] + 2 * (weight[1:] * cov[1:]).sum(), cov[0]) / n
        return pd.DataFrame([out], columns=[*keys, "n", "v"])

    kinds = "".join(f"{k} {products.schema[k].dataType.simpleString()}, " for k in keys)
    by = products.select(*keys, "symbol", "bar_idx", column).groupBy(*keys, "symbol").applyInPandas(run, kinds + "n long, v double")
    used = by.where(~F.isnan("v"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return used.withColumn("w", share).groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("v"))).alias("se_newey_west"))


def average_rank(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The column as ranks, ties sharing their mean rank."""
    w = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, column))
    return df.withColumn(column, F.rank().over(w.orderBy(column)) + (ties - 1) / 2.0)


def products(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """x: the product of the standardised signal and forward return (population moments over all defined cells)."""
    own = cells.withColumn("signal", defined("signal")).withColumn("fwd", defined("fwd")).where("signal IS NOT NULL AND fwd IS NOT NULL")
    moments = own.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("signal", "fwd") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    # one row of moments for each combination of keys
    joined = own.join(F.broadcast(moments), list(keys)) if keys else own.join(F.broadcast(moments))
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}"))
    return joined.withColumn("x", z("signal") * z("fwd")).select(*keys, "ts", "bar_idx", "symbol", "x")


def compute_ic(cells: DataFrame, horizon: int, residualise: bool = True, lags: int | None = None, lag_multiple: float = 2.0, min_symbols: int = 2, keys: tuple[str, ...] = (), fft: bool | None = None) -> DataFrame:
    """ic, standard errors (iid, Driscoll-Kraay, by asset), t, n_effective, variance inflation of each combination of keys.

    The forward returns are demeaned before cells without a signal are
    dropped.  Driscoll-Kraay: the products' mean at each valid period, and
    Newey-West over these periods, with lags round(lag_multiple * horizon), by
    FFT if fft or, where that is None, above LAGS lags.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    x = products(demean(cells, "fwd", keys) if residualise else cells, keys)
    pooled = x.groupBy(*keys).agg(F.avg("x").alias("ic"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n_raw"), F.countDistinct("symbol").alias("n_symbols"))
    per_period = x.where("x IS NOT NULL").groupBy(*keys, "ts", "bar_idx").agg(F.avg("x").alias("m"), F.count("x").alias("c"))
    valid = per_period.where(F.col("c") >= min_symbols)
    n_lags = max(1, int(round(lag_multiple * horizon)) if lags is None else lags)
    fft = n_lags > LAGS if fft is None else fft
    dk = (newey_west_fft if fft else newey_west)(valid, "m", n_lags, keys).select(*keys, F.col("n").alias("n_periods"), F.when(F.col("n") >= 5, F.col("se")).alias("se_dk"))
    by_asset = x.where("x IS NOT NULL").groupBy(*keys, "symbol").agg(F.avg("x").alias("m")).groupBy(*keys).agg((F.stddev_samp("m") / F.sqrt(F.count("m").cast("double"))).alias("se_cluster_asset"))
    on = list(keys)
    out = pooled.join(dk, on, "left").join(by_asset, on, "left") if on else pooled.join(F.broadcast(dk), F.lit(True), "left").join(F.broadcast(by_asset))  # one row each, by FFT none without periods
    n = F.col("n_raw").cast("double")
    usable = (F.col("n_raw") >= 10) & F.col("ic").isNotNull()
    out = out.withColumn("ic", F.when(usable, F.col("ic"))).withColumn("se_iid", F.sqrt(F.greatest(1 - F.col("ic") * F.col("ic"), F.lit(0.0)) / (n - 2)))
    out = out.withColumn("t_iid", ratio("ic", "se_iid")).withColumn("t_hac", ratio("ic", "se_dk"))
    out = out.withColumn("n_effective", F.pow(ratio("sd", "se_dk"), F.lit(2.0))).withColumn("variance_inflation", F.pow(ratio("se_dk", F.col("sd") / F.sqrt(n)), F.lit(2.0)))
    return out.withColumn("n_effective_naive", n / horizon).withColumn("hac_lags", F.lit(n_lags)).withColumn("horizon", F.lit(horizon))


def information_coefficient(pairs: DataFrame, method: str = "pearson", overlap: int = 1, order: str = "bar_idx") -> DataFrame:
    """ic, n, naive and HAC standard errors and t of one series of (signal, fwd)."""
    own = pairs.where("signal IS NOT NULL AND fwd IS NOT NULL")
    if method == "spearman":
        own = average_rank(average_rank(own, "signal"), "fwd")
    n = own.count()
    lags = min(max(overlap - 1, int(4 * (n / 100) ** (2 / 9))), max(n - 2, 0))
    x = products(own.withColumn("symbol", F.lit("")).withColumn("ts", F.col(order)))
    se = newey_west(x, "x", lags, order="bar_idx").select("se")
    ic = x.agg(F.avg("x").alias("ic"), F.count("x").alias("n"), (F.stddev_samp("x") / F.sqrt(F.count("x").cast("double"))).alias("se_naive"))
    return ic.join(F.broadcast(se)).select("ic", "n", "se_naive", F.col("se").alias("se_hac"), F.lit(lags).alias("hac_lags"), ratio("ic", "se").alias("t_stat"))


def adjust_p_values(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """p_value_bh and p_value_by: step-up adjusted p-values (Benjamini-Hochberg, -Yekutieli); null p stay null.

    The tests of a family are few; they are one window.
    """
    defined_ = F.col(p).isNotNull()
    every = Window.partitionBy(defined_)
    m = F.count(p).over(every)
    rank = F.row_number().over(every.orderBy(F.col(p)))
    ranked = tests.withColumn("_m", m).withColumn("_r", rank)
    back = Window.partitionBy(defined_).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    step_up = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(back)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("_m"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)
    out = ranked.withColumn("_s", step_up).withColumn("p_value_bh", F.when(defined_, F.least(F.col("_s"), F.lit(1.0))))
    return out.withColumn("p_value_by", F.when(defined_, F.least(F.col("_s") * harmonic, F.lit(1.0)))).drop("_m", "_r", "_s")


def breakeven(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The one-way cost at which the signal's gain is gone: |ic| sd(residual) / (2 E|z|), in basis points too."""
    resid = demean(cells, "fwd", keys)
    ic = products(resid, keys).groupBy(*keys).agg(F.avg("x").alias("ic"))
    spread = resid.groupBy(*keys).agg(F.stddev_pop("fwd").alias("sigma_r"), F.avg("signal").alias("ms"), F.stddev_pop("signal").alias("ss"))
    on = list(keys)
    z = (cells.join(F.broadcast(spread), on) if on else cells.join(F.broadcast(spread))).groupBy(*keys).agg(F.avg(F.abs(ratio(F.col("signal") - F.col("ms"), "ss"))).alias("e_abs_z"), F.max("sigma_r").alias("sigma_r"))
    out = ic.join(z, on) if on else ic.join(F.broadcast(z))
    c = F.abs("ic") * F.col("sigma_r") / (2 * F.col("e_abs_z"))
    return out.withColumn("gross_bps", F.abs("ic") * F.col("sigma_r") * 1e4).withColumn("c_star_bps", c * 1e4)


def parts(df: DataFrame, n: int) -> DataFrame:
    """part 0 ... n - 1 of each bar: consecutive blocks with borders part * bars div n."""
    bars = df.agg((F.max("bar_idx") + 1).alias("_bars"))
    own = df.join(F.broadcast(bars))  # one row
    # the greatest part whose border isn't after the bar
    part = F.expr(f"cast(((bar_idx + 1) * {n} - 1) div _bars as int)")
    return own.withColumn("part", part).drop("_bars")


def data_quality(bars: DataFrame, per_session: int) -> DataFrame:
    """Sessions, bars a session, and the share of missing cells. bars: session, ts, bar_idx, symbol, px."""
    stamps = bars.select("session", "ts").distinct().groupBy("session").count()
    cells = bars.agg(F.avg(F.col("px").isNull().cast("double")).alias("missing"), F.countDistinct("symbol").alias("symbols"))
    return stamps.agg(F.count(F.lit(1)).alias("sessions"), F.avg("count").alias("bars_per_session"), F.count_if(F.col("count") == per_session).alias("complete_sessions")).join(F.broadcast(cells))
