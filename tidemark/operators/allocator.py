"""Weights by regime, and the budget of trades."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEAD_BAND = 0.05
Weights = Mapping[str, Mapping[str, float]]

#: The prior weights of the strategies in the two trend regimes.
DEFAULT_WEIGHTS: dict[str, dict[str, float]] = {
    "trend": {"zscore_reversion": 0.05, "zscore_momentum": 0.25, "timeseries_momentum": 0.35, "ma_crossover": 0.25, "vol_breakout": 0.10},
    "chop": {"zscore_reversion": 0.55, "zscore_momentum": 0.05, "timeseries_momentum": 0.10, "ma_crossover": 0.10, "vol_breakout": 0.20},
}
REVERSION = ("zscore_reversion",)


def weight_table(spark, weights: Weights, strategies: list[str]) -> DataFrame:
    """regime, strategy, weight: a row for every strategy of every regime (0 where it is left out)."""
    for regime, own in weights.items():
        if unknown := set(own) - set(strategies):
            raise ValueError(f"{regime}: unknown strategies {sorted(unknown)}")
        if missing := set(strategies) - set(own):
            warnings.warn(f"{regime}: no weight for {sorted(missing)}, 0 is used", stacklevel=2)
    rows = [(regime, s, float(own.get(s, 0.0))) for regime, own in weights.items() for s in strategies]
    return spark.createDataFrame(rows, "regime string, strategy string, weight double")


def regime_weights(labels: DataFrame, weights: Weights, strategies: list[str], default: Mapping[str, float] | None = None) -> DataFrame:
    """ts, bar_idx, strategy, weight; bars whose label is null or unknown have the default (equal weights)."""
    default = default or {s: 1.0 / len(strategies) for s in strategies}
    spark = labels.sparkSession
    every = labels.select("ts", "bar_idx", "regime", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"))
    own = weight_table(spark, weights, strategies)
    base = spark.createDataFrame([(s, float(default.get(s, 0.0))) for s in strategies], "strategy string, base double")
    # both tables have a row for each strategy (of each regime) only
    joined = every.join(F.broadcast(own), ["regime", "strategy"], "left").join(F.broadcast(base), "strategy")
    return joined.select("ts", "bar_idx", "strategy", F.coalesce("weight", "base").alias("weight"))


def resolve_weights(labels: DataFrame, base: Weights) -> DataFrame:
    """label and source: for compound labels (parts joined by |) the first part, or the label itself, that has weights."""
    known = labels.select(F.col("regime").alias("label")).where("regime IS NOT NULL").distinct()
    if not base:
        return known.withColumn("source", F.lit(None).cast("string"))
    parts = known.select("label", F.posexplode(F.concat(F.array("label"), F.split("label", "\\|"))).alias("pos", "part"))
    hit = parts.where(F.col("part").isin(list(base))).groupBy("label").agg(F.min_by("part", "pos").alias("source"))
    return known.join(hit, "label", "left")


def weight_coverage(labels: DataFrame, base: Weights) -> DataFrame:
    """The share of labelled bars whose label finds weights."""
    own = labels.where("regime IS NOT NULL").withColumnRenamed("regime", "label").join(resolve_weights(labels, base), "label")
    return own.agg(F.avg(F.col("source").isNotNull().cast("double")).alias("coverage"))


def tier3_weights(base: Weights = DEFAULT_WEIGHTS, tilt: float = 0.6, concentration: float = 0.5) -> dict[str, dict[str, float]]:
    """Twelve vectors: the favoured strategies times 1 + tilt, raised to a power by volatility, normalised."""
    from tidemark.operators.regime import SIGN_LABELS, TREND_LABELS, VOL_LABELS

    powers = dict(zip(VOL_LABELS, (1 - concentration, 1.0, 1 + concentration)))

    def vector(vol: str, trend: str, sign: str) -> dict[str, float]:
        favoured = lambda s: (s in REVERSION) == (sign == "ac-")
        raw = {s: (w * (1 + tilt if favoured(s) else 1.0)) ** powers[vol] for s, w in base[trend].items()}
        return {s: w / (sum(raw.values()) or 1.0) for s, w in raw.items()}

    return {f"{v}|{t}|{a}": vector(v, t, a) for v in VOL_LABELS for t in TREND_LABELS for a in SIGN_LABELS}


def combine(targets: DataFrame, weights: DataFrame) -> DataFrame:
    """ts, bar_idx, symbol, position: the weighted sum of the strategies' targets (target: ts, bar_idx, symbol, strategy, signal)."""
    joined = targets.join(weights.select("bar_idx", "strategy", "weight"), ["bar_idx", "strategy"])
    return joined.groupBy("ts", "bar_idx", "symbol").agg(F.sum(F.coalesce("signal", F.lit(0.0)) * F.col("weight")).alias("position"))


def trade_value(delta: Column, edge: Column, cost_bps: float, fixed_bps: float = 0.0) -> Column:
    return F.abs(delta) * (edge - cost_bps / 1e4) - fixed_bps / 1e4


def select_trades(rows: DataFrame, budget: int, cost_bps: float, keys: tuple[str, ...] = ("ts",), dead_band: float = DEAD_BAND, fixed_bps: float = 0.0) -> DataFrame:
    """The audit of one bar each: rows with desired, current and edge get delta, value, executed and reason.

    The `budget` best by value, then by name, are executed.
    """
    delta = F.coalesce("desired", "current") - F.col("current")
    out = rows.withColumn("delta", delta).withColumn("value", trade_value(F.col("delta"), F.coalesce("edge", F.lit(0.0)), cost_bps, fixed_bps))
    out = out.withColumn("_big", F.abs("delta") > dead_band).withColumn("_eligible", F.col("_big") & (F.col("value") > 0))
    w = Window.partitionBy(*keys, "_eligible").orderBy(F.col("value").desc(), "symbol")
    out = out.withColumn("executed", F.col("_eligible") & (F.row_number().over(w) <= budget))
    reason = F.when(F.col("executed"), "executed").when(F.col("_eligible"), "budget_exhausted").when(~F.col("_big"), "below_min_trade_size").otherwise("negative_expected_value")
    return out.withColumn("reason", reason).drop("_big", "_eligible")


def trade_budget(targets: DataFrame, budget: int, cost_bps: float, edge_bps: float = 5.0, book: tuple[str, ...] = ("book",), dead_band: float = DEAD_BAND, fixed_bps: float = 0.0) -> DataFrame:
    """At most `budget` trades a calendar day: the book of a bar depends on the trades of all bars before.

    targets: the keys in `book`, ts, bar_idx, symbol, desired (null: hold) and,
    if edges differ, edge.  Returns each cell's position, delta, value,
    executed and reason.  A book is one group, as its bars depend on each
    other; books run in parallel.
    """
    keys = list(book)
    if "edge" not in targets.columns:
        targets = targets.withColumn("edge", F.lit(edge_bps / 1e4))
    kinds = ", ".join(f"{k} {targets.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # of rows that repeat a bar and symbol, the one with the greatest target
        pdf = pdf.sort_values(["desired", "edge"], na_position="first").drop_duplicates(["bar_idx", "symbol"], keep="last")
        desired = pdf.pivot(index="bar_idx", columns="symbol", values="desired").sort_index()
        edge = pdf.pivot(index="bar_idx", columns="symbol", values="edge").reindex_like(desired).fillna(0.0).to_numpy()
        stamps = pdf.groupby("bar_idx")["ts"].first().sort_index()
        days = stamps.dt.normalize().to_numpy()
        names = np.array([str(c) for c in desired.columns])
        want, n = desired.to_numpy(dtype=float), desired.shape[1]
        current, left, day, out = np.zeros(n), budget, None, []
        by_name = np.argsort(np.argsort(names))
        for i in range(len(want)):
            if days[i] != day:
                day, left = days[i], budget
            target = np.where(np.isnan(want[i]), current, want[i])
            delta = target - current
            value = np.abs(delta) * (edge[i] - cost_bps / 1e4) - fixed_bps / 1e4
            big = np.abs(delta) > dead_band
            eligible = big & (value > 0)
            done = np.zeros(n, bool)
            picked = np.flatnonzero(eligible)
            done[picked[np.lexsort((by_name[picked], -value[picked]))][:left]] = True
            left -= int(done.sum())
            current = np.where(done, target, current)
            reason = np.select([done, eligible, ~big], ["executed", "budget_exhausted", "below_min_trade_size"], "negative_expected_value")
            out.append(pd.DataFrame({"ts": stamps.iloc[i], "bar_idx": desired.index[i], "symbol": names, "position": current, "delta": delta, "value": value, "executed": done, "reason": reason}))
        frame = pd.concat(out, ignore_index=True)
        for k in keys:
            frame[k] = pdf[k].iloc[0]
        return frame

    schema = f"ts timestamp, bar_idx long, symbol string, position double, delta double, value double, executed boolean, reason string, {kinds}"
    return targets.select(*keys, "ts", "bar_idx", "symbol", "desired", "edge").groupBy(*keys).applyInPandas(run, schema)


def budget_used(decisions: DataFrame, book: tuple[str, ...] = ("book",)) -> DataFrame:
    return decisions.groupBy(*book, F.to_date("ts").alias("day")).agg(F.count_if("executed").alias("budget_used"))


def rejection_reasons(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.col("executed")).groupBy("reason").count()
