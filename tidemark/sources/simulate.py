"""Synthetic price panels.

Random numbers are keyed by seed, step and asset, so a longer panel keeps its
beginning and no number depends on the partitioning.  Recursions run in one
task for each seed and asset (or seed, where the state is shared); many seeds run
in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 1 / 252


def business_days(spark: SparkSession, n: int, start: str = "2015-01-01") -> DataFrame:
    """ts and bar_idx of the first n weekdays from start on."""
    span = n * 7 // 5 + 7
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(start)), span))).alias("d"))
    weekdays = days.where(F.weekday("d") < 5).withColumn("bar_idx", (F.row_number().over(Window.orderBy("d")) - 1).cast("long"))
    return weekdays.where(F.col("bar_idx") < n).select(F.col("d").cast("timestamp").alias("ts"), "bar_idx")


def _unit(*key):
    """A uniform number above 0 and below 1 for each key: 52 bits of its MD5, so any SQL engine draws the same."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _normal(*key):
    """A standard normal number for each key (Box-Muller on keyed uniforms)."""
    return F.sqrt(-2 * F.ln(_unit(*key, F.lit("u")))) * F.cos(2 * math.pi * _unit(*key, F.lit("v")))


def shocks(spark: SparkSession, seeds: list[int], n_steps: int, n_assets: int, correlation: float = 0.0) -> DataFrame:
    """seed, bar_idx, asset and z: normals with one correlation between all assets.

    A common factor gives correlations from 0 on; below 0 (down to
    -1 / (n - 1)) the assets' own numbers less a share of their mean do.
    """
    if n_assets > 1 and not -1 / (n_assets - 1) < correlation < 1:
        raise ValueError("correlation must be above -1/(n_assets - 1) and below 1")
    base = spark.range(n_steps).select(F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("seed"), F.col("id").alias("bar_idx"))
    cells = base.select("seed", "bar_idx", F.explode(F.sequence(F.lit(0), F.lit(n_assets - 1))).alias("asset"))
    own = cells.withColumn("e", _normal("seed", "bar_idx", "asset"))
    if correlation >= 0:
        return own.withColumn("z", math.sqrt(correlation) * _normal("seed", "bar_idx", F.lit("common")) + math.sqrt(1 - correlation) * F.col("e")).drop("e")
    a, b = math.sqrt(1 - correlation), math.sqrt(1 + (n_assets - 1) * correlation)
    mean = F.avg("e").over(Window.partitionBy("seed", "bar_idx"))
    return own.withColumn("z", a * (F.col("e") - mean) + b * mean).drop("e")


def _prices(log_price: DataFrame, n_steps: int, start: str) -> DataFrame:
    stamps = business_days(log_price.sparkSession, n_steps, start)
    out = log_price.select("seed", "bar_idx", F.concat(F.lit("asset_"), F.col("asset").cast("string")).alias("symbol"), F.exp("lp").alias("px"))
    return out.join(stamps, "bar_idx")


def gbm(spark: SparkSession, n_steps: int = 1000, n_assets: int = 1, seeds: list[int] = [0], mu: float = 0.0, sigma: float = 0.2, correlation: float = 0.0, s0: float = 100.0, dt: float = DAY, start: str = "2015-01-01") -> DataFrame:  # noqa: B006
    """Geometric Brownian motion, beginning at s0."""
    step = F.when(F.col("bar_idx") == 0, 0.0).otherwise((mu - sigma * sigma / 2) * dt + sigma * math.sqrt(dt) * F.col("z"))
    w = Window.partitionBy("seed", "asset").orderBy("bar_idx")
    z = shocks(spark, seeds, n_steps, n_assets, correlation)
    return _prices(z.withColumn("lp", math.log(s0) + F.sum(step).over(w)), n_steps, start)


def _recursion(z: DataFrame, keys: list[str], step, extra: str = "") -> DataFrame:
    kinds = ", ".join(f"{k} {z.schema[k].dataType.simpleString()}" for k in keys)
    rest = [c for c in ("asset",) if c not in keys]
    schema = f"{kinds}, bar_idx long, {''.join(f'{c} int, ' for c in rest)}lp double{extra}"
    return z.groupBy(*keys).applyInPandas(step, schema)


def ornstein_uhlenbeck(spark: SparkSession, n_steps: int = 1000, n_assets: int = 1, seeds: list[int] = [0], half_life: float = 10.0, sigma: float = 0.2, correlation: float = 0.0, s0: float = 100.0, dt: float = DAY, start: str = "2015-01-01") -> DataFrame:  # noqa: B006
    """Mean-reverting log prices: the exact AR(1) of the process at steps of one bar."""
    theta = math.log(2) / half_life
    phi, spread = math.exp(-theta), math.sqrt(sigma * sigma * dt / (2 * theta) * (1 - math.exp(-2 * theta)))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        x, out = 0.0, []
        for i, z in enumerate(pdf["z"]):
            x = 0.0 if i == 0 else phi * x + spread * z
            out.append(x)
        return pdf.assign(lp=math.log(s0) + np.array(out))[["seed", "asset", "bar_idx", "lp"]]

    return _prices(_recursion(shocks(spark, seeds, n_steps, n_assets, correlation), ["seed", "asset"], step), n_steps, start)


def garch_t(spark: SparkSession, n_steps: int = 1000, n_assets: int = 1, seeds: list[int] = [0], target_vol: float = 0.2, alpha: float = 0.08, beta: float = 0.9, nu: float = 5.0, mu: float = 0.0, correlation: float = 0.0, s0: float = 100.0, dt: float = DAY, start: str = "2015-01-01") -> DataFrame:  # noqa: B006
    """GARCH(1,1) with Student-t shocks of unit variance."""
    if alpha + beta >= 1 or nu <= 2:
        raise ValueError("need alpha + beta < 1 and nu > 2")
    long_run = target_vol * target_vol * dt
    whole, rest = int(nu), nu - int(nu)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        chi = pdf["chi"].to_numpy() / nu
        if rest:  # the part of the chi-square below one degree of freedom
            key = [int(pdf["seed"].iloc[0]) & 0xFFFFFFFF, int(pdf["asset"].iloc[0])]
            chi = chi + 2 * np.random.default_rng(key).standard_gamma(rest / 2, len(pdf)) / nu
        t = pdf["z"].to_numpy() / np.sqrt(chi) * math.sqrt((nu - 2) / nu)
        var, out = long_run, np.zeros(len(pdf))
        for i in range(1, len(pdf)):
            e = math.sqrt(var) * t[i]
            out[i] = mu * dt - var / 2 + e
            var = long_run * (1 - alpha - beta) + alpha * e * e + beta * var
        return pdf.assign(lp=math.log(s0) + np.cumsum(out))[["seed", "asset", "bar_idx", "lp"]]

    square = lambda k: F.pow(_normal("seed", "bar_idx", "asset", F.lit("chi"), k), F.lit(2.0))
    z = shocks(spark, seeds, n_steps, n_assets, correlation)
    z = z.withColumn("chi", F.aggregate(F.sequence(F.lit(1), F.lit(whole)), F.lit(0.0), lambda a, k: a + square(k)))
    return _prices(_recursion(z, ["seed", "asset"], step), n_steps, start)


def regime_switching(spark: SparkSession, n_steps: int = 1000, n_assets: int = 1, seeds: list[int] = [0], p_stay_trend: float = 0.97, p_stay_chop: float = 0.97, drift: float = 0.6, half_life: float = 5.0, sigma: float = 0.2, correlation: float = 0.0, s0: float = 100.0, dt: float = DAY, start: str = "2015-01-01", with_states: bool = False) -> DataFrame:  # noqa: B006
    """A market that trends or chops: each trend draws a direction for each asset, each chop reverts to where it began."""
    if not (0 <= p_stay_trend <= 1 and 0 <= p_stay_chop <= 1):
        raise ValueError("p_stay_trend and p_stay_chop are probabilities")
    pull = 1 - math.exp(-math.log(2) / half_life)
    leave = (1 - p_stay_trend) + (1 - p_stay_chop)
    stationary = (1 - p_stay_chop) / leave if leave > 0 else 0.5  # the chain's long-run share of trends

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        z, drawn = (pdf.pivot(index="bar_idx", columns="asset", values=c).sort_index() for c in ("z", "direction"))
        n, m = z.shape
        signs = np.where(drawn.to_numpy() < 0.5, 1.0, -1.0)
        switch = pdf.groupby("bar_idx")["switch"].first().sort_index().to_numpy()
        trend, x, anchor, sign = switch[0] < stationary, np.zeros(m), np.zeros(m), signs[0]
        lp, states = np.zeros((n, m)), ["trend" if trend else "chop"]
        for i in range(1, n):
            if switch[i] > (p_stay_trend if trend else p_stay_chop):
                trend = not trend
                sign, anchor = signs[i], x.copy()
            noise = sigma * math.sqrt(dt) * z.to_numpy()[i]
            x = x + (sign * drift * dt + noise if trend else pull * (anchor - x) + noise)
            lp[i] = x
            states.append("trend" if trend else "chop")
        out = pd.DataFrame(math.log(s0) + lp, index=z.index, columns=z.columns).stack().rename("lp").reset_index()
        out["state"] = out["bar_idx"].map(dict(zip(z.index, states)))
        return out.assign(seed=pdf["seed"].iloc[0])[["seed", "bar_idx", "asset", "lp", "state"]]

    z = shocks(spark, seeds, n_steps, n_assets, correlation)
    # the state is shared by the assets of a seed, its direction isn't
    z = z.withColumns({"switch": _unit("seed", "bar_idx", F.lit("state")), "direction": _unit("seed", "bar_idx", "asset", F.lit("direction"))})
    raw = _recursion(z, ["seed"], step, ", state string")
    prices = _prices(raw, n_steps, start)
    if not with_states:
        return prices
    return prices.join(raw.groupBy("seed", "bar_idx").agg(F.max("state").alias("state")), ["seed", "bar_idx"])
