"""The portfolio: regimes weigh strategies, the book is scaled to a volatility and trades within a budget."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import allocator, engine, regime, sizing
from tidemark.operators.signals import CONTROLS, Signal, default_signals
from tidemark.plans.panel import simple_returns


@dataclass
class Portfolio:
    books: DataFrame  # book, ts, bar_idx, gross, cost, turnover, trades, net
    regimes: DataFrame
    weights: DataFrame
    decisions: DataFrame
    cells: DataFrame  # held positions of the budgeted books
    warmup: int

    def ledger(self) -> DataFrame:
        return engine.ledger(self.books)

    def verdict(self) -> dict:
        """Whether conditioning on regimes is worth the luck it adds; strategies are counted with the controls."""
        rows = {r.book: r for r in self.ledger().select("book", "sharpe", "n_periods").collect()}
        n_regimes = self.regimes.where("regime IS NOT NULL").select("regime").distinct().count()
        return engine.regime_verdict(rows["regime_conditional"].sharpe, rows["fixed_weight"].sharpe, len(rows) - 2, max(n_regimes, 1), rows["regime_conditional"].n_periods)


def targets(panel: DataFrame, signals: list[Signal]) -> DataFrame:
    """ts, bar_idx, symbol, strategy, signal of all signals."""
    one = lambda s: s(panel).select("ts", "bar_idx", "symbol", F.lit(s.name).alias("strategy"), "signal")
    return reduce(DataFrame.unionByName, [one(s) for s in signals])


def run_portfolio(
    panel: DataFrame,
    signals: list[Signal] | None = None,
    weights: dict | None = None,
    tier: int = 0,
    budget: int = 3,
    cost_bps: float = 2.0,
    target_vol: float = 0.10,
    max_leverage: float = 3.0,
    vol_lookback: int = 60,
    min_periods: int = regime.MIN_PERIODS,
    edge_bps: float = 5.0,
    dead_band: float = allocator.DEAD_BAND,
    lag: int = 1,
    allow_tier3: bool = False,
) -> Portfolio:
    """The conditional and the fixed book within the budget, and every signal on its own without one."""
    signals = signals or default_signals()
    research = [s for s in signals if s.name not in CONTROLS]
    names = [s.name for s in research]
    priced = simple_returns(panel)
    labels = regime.classify(panel, tier, min_periods=min_periods, allow_tier3=allow_tier3)
    warmup = max(s.lookback for s in signals) + min_periods + vol_lookback + 1
    every = targets(priced, signals)
    own = {} if tier < 2 else allocator.tier3_weights(weights or allocator.DEFAULT_WEIGHTS) if tier == 3 else (weights or allocator.DEFAULT_WEIGHTS)
    own = {r: {s: w for s, w in v.items() if s in names} for r, v in own.items()}
    by_regime = allocator.regime_weights(labels, own, names)
    equal = allocator.regime_weights(labels, {}, names)
    mine = every.where(F.col("strategy").isin(names))
    desired = None
    for book, w in (("regime_conditional", by_regime), ("fixed_weight", equal)):
        combined = allocator.combine(mine, w).join(priced.select("bar_idx", "symbol", "ret"), ["bar_idx", "symbol"])
        sized = sizing.vol_target(combined, target_vol, vol_lookback, max_leverage)
        part = sized.select(F.lit(book).alias("book"), "ts", "bar_idx", "symbol", F.col("position").alias("desired"))
        desired = part if desired is None else desired.unionByName(part)
    decisions = allocator.trade_budget(desired, budget, cost_bps, edge_bps, ("book",), dead_band)
    px = panel.select("bar_idx", "symbol", "px")
    held = decisions.select("book", "ts", "bar_idx", "symbol", F.col("position").alias("signal")).join(px, ["bar_idx", "symbol"])
    alone = every.select(F.col("strategy").alias("book"), "ts", "bar_idx", "symbol", "signal").join(px, ["bar_idx", "symbol"])
    both = held.unionByName(alone).join(priced.select("bar_idx", "symbol", "ret"), ["bar_idx", "symbol"])
    books = engine.backtest(both, "signal", cost_bps, lag, warmup, ("book",), min_trade=dead_band)
    return Portfolio(books, labels, by_regime, decisions, engine.asset_backtest(both, "signal", cost_bps, lag, warmup, ("book",)), warmup)
