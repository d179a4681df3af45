"""Sessions: a simulated market is computed once and revealed bar by bar; every answer is plain data for JSON.

Revealing by a cursor is right because every signal, regime and position uses the past only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import engine, metrics, regime, validate
from tidemark.plans.panel import downsample
from tidemark.plans.portfolio import Portfolio, run_portfolio
from tidemark.sources import simulate

GENERATORS = {"gbm": simulate.gbm, "ornstein_uhlenbeck": simulate.ornstein_uhlenbeck, "garch_t": simulate.garch_t, "regime_switching": simulate.regime_switching}
MAX_SESSIONS = 32


@dataclass(frozen=True)
class Config:
    """The settings of a session, within their ranges."""

    generator: str = "gbm"
    n_steps: int = 1000
    n_assets: int = 5
    correlation: float = 0.2
    seed: int = 0
    cost_bps: float = 2.0
    budget: int = 3
    target_vol: float = 0.10
    max_leverage: float = 3.0
    tier: int = 0
    allow_tier3: bool = False
    edge_bps: float = 5.0
    dead_band: float = 0.05

    def __post_init__(self):
        ranges = {"n_steps": (300, 10_000), "n_assets": (1, 50), "correlation": (-0.99, 0.99), "cost_bps": (0, 100), "budget": (0, 1000), "target_vol": (0.001, 2), "max_leverage": (0.1, 20), "tier": (0, 3), "edge_bps": (0, 1000), "dead_band": (0, 1)}
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be within {low} and {high}")
        if self.generator not in GENERATORS:
            raise ValueError(f"unknown generator {self.generator}")


@dataclass
class Session:
    config: Config
    panel: DataFrame
    portfolio: Portfolio
    cursor: int = 0
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])


class Api:
    def __init__(self, spark: SparkSession):
        self.spark, self.sessions = spark, {}

    def health(self) -> dict:
        return {"status": "ok", "sessions": len(self.sessions)}

    def defaults(self) -> dict:
        return {f.name: f.default for f in fields(Config)}

    def _build(self, config: Config) -> Session:
        prices = GENERATORS[config.generator](self.spark, config.n_steps, config.n_assets, [config.seed], correlation=config.correlation)
        panel = prices.select("symbol", "ts", "bar_idx", "px").persist()
        made = run_portfolio(panel, tier=config.tier, budget=config.budget, cost_bps=config.cost_bps, target_vol=config.target_vol, max_leverage=config.max_leverage, edge_bps=config.edge_bps, dead_band=config.dead_band, allow_tier3=config.allow_tier3)
        made.books, made.cells = made.books.persist(), made.cells.persist()
        return Session(config, panel, made, made.warmup)

    def create(self, **settings) -> dict:
        while len(self.sessions) >= MAX_SESSIONS:  # the oldest goes
            self.delete(next(iter(self.sessions)))
        session = self._build(Config(**settings))
        self.sessions[session.id] = session
        return {"id": session.id, "n_steps": session.config.n_steps, "cursor": session.cursor, "warmup": session.portfolio.warmup}

    def update(self, id: str, **settings) -> dict:
        old = self.sessions[id]
        new = self._build(Config(**(old.config.__dict__ | settings)))
        new.id, new.cursor = id, min(old.cursor, new.config.n_steps - 1)
        self.sessions[id] = new
        return {"id": id, "cursor": new.cursor}

    def delete(self, id: str) -> dict:
        session = self.sessions.pop(id)
        for df in (session.panel, session.portfolio.books, session.portfolio.cells):
            df.unpersist()
        return {"deleted": id}

    def tick(self, id: str, steps: int = 1, max_points: int = 220, trips: int = 40) -> dict:
        """What is visible after `steps` more bars."""
        s = self.sessions[id]
        s.cursor = min(s.cursor + steps, s.config.n_steps - 1)
        seen = lambda df: df.where(F.col("bar_idx") <= s.cursor)
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        books = seen(s.portfolio.books)
        curve = metrics.equity(books.where("book = 'regime_conditional'"), "net", ("book",)).select("ts", "equity", "drawdown")
        return {
            "cursor": s.cursor,
            "done": s.cursor == s.config.n_steps - 1,
            "equity": rows(downsample(curve, max_points).orderBy("ts")),
            "strategies": rows(engine.ledger(books)),
            "bands": rows(regime.bands(seen(s.portfolio.regimes)).orderBy("band")),
            "round_trips": rows(engine.round_trips(seen(s.portfolio.cells).where("book = 'regime_conditional'"), trips)),
        }

    def backtest(self, log: str | None = None, at: str = "", **settings) -> dict:
        """The ledger and the verdict of one run; log: where the trial is written to."""
        session = self._build(Config(**settings))
        ledger = [r.asDict() for r in session.portfolio.ledger().collect()]
        verdict = session.portfolio.verdict()
        if log:
            own = next(r for r in ledger if r["book"] == "regime_conditional")
            validate.log_trial(self.spark, log, "backtest", session.config.__dict__, {"sharpe_ann": own["sharpe"], "sharpe_per_period": own["sharpe_per_period"]}, at)
        return validate.jsonable({"ledger": ledger, "verdict": verdict})

    def research_log(self, path: str, limit: int = 200, n_periods: int = 2500) -> dict:
        """The last lines of the trial log and the threshold of luck after all of them."""
        trials = validate.read_trials(self.spark, path)
        last = trials.orderBy(F.col("timestamp").desc_nulls_last()).limit(limit)
        return validate.jsonable({"trials": [r.asDict() for r in last.collect()], "threshold": validate.current_threshold(trials, n_periods)})
