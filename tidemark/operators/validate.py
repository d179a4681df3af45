"""Walk-forward and purged validation, and the log of trials."""

from __future__ import annotations

import itertools
import json
import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.engine import backtest
from tidemark.plans.panel import simple_returns


def grid(**values: list) -> list[dict[str, Any]]:
    """All combinations of parameter values, the last one varying fastest."""
    return [dict(zip(values, c)) for c in itertools.product(*values.values())]


def folds(n: int, train: int, test: int, step: int | None = None) -> list[tuple[int, int, int, int]]:
    """(fold, first train bar, first test bar, end) of rolling folds."""
    if train < 2 or test < 1 or n < train + test:
        raise ValueError("need train >= 2, test >= 1 and at least train + test bars")
    step = step or test
    return [(k, s, s + train, s + train + test) for k, s in enumerate(range(0, n - train - test + 1, step))]


def _blocks(panel: DataFrame, factory, points: list[dict[str, Any]], train: int, test: int, step: int | None, warmup: int, cost_bps: float, lag: int) -> DataFrame:
    """The net book of every fold, point and kind (train, test) by bar, in one plan."""
    spark = panel.sparkSession
    n = panel.agg(F.max("bar_idx") + 1).first()[0] or 0
    blocks = [(k, i, kind, lo, hi, max(0, lo - warmup)) for k, a, b, c in folds(n, train, test, step) for i in range(len(points)) for kind, lo, hi in (("train", a, b), ("test", b, c))]
    table = spark.createDataFrame(blocks, "fold int, point int, kind string, lo long, hi long, first long")
    every, panel = None, simple_returns(panel)
    for i, p in enumerate(points):
        own = factory(**p)(panel).select("ts", "bar_idx", "symbol", "ret", "signal").withColumn("point", F.lit(i))
        every = own if every is None else every.unionByName(own)
    # the table of blocks has folds x points x 2 rows, whatever the number of symbols
    rows = every.join(F.broadcast(table), "point").where("bar_idx >= first AND bar_idx < hi")
    rows = rows.withColumn("ret", F.when(F.col("bar_idx") > F.col("first"), F.col("ret")))  # a block's first bar has no return
    return backtest(rows, "signal", cost_bps, lag, keys=("fold", "point", "kind", "lo", "first")).where(F.col("bar_idx") >= F.greatest("lo", F.col("first") + warmup))


def _scores(book: DataFrame) -> DataFrame:
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    scores = book.groupBy("fold", "point", "kind").agg(metrics.sharpe("net").alias("sharpe"), F.sum("net").alias("total"))
    pairs = scores.groupBy("fold", "point").agg(of("train", "sharpe").alias("train_sharpe"), of("test", "sharpe").alias("test_sharpe"), of("test", "total").alias("test_return"))
    best = Window.partitionBy("fold").orderBy(F.coalesce("train_sharpe", F.lit(float("-inf"))).desc(), "point")
    return pairs.withColumn("selected", F.row_number().over(best) == 1)


def walk_forward(panel: DataFrame, factory, points: list[dict[str, Any]], train: int = 504, test: int = 126, step: int | None = None, warmup: int = 0, cost_bps: float = 2.0, lag: int = 1, log: str | None = None, at: str = "") -> DataFrame:
    """One row for each fold and parameter point: train and test Sharpe ratio and return, and which point was selected.

    factory(**point) is a signal.  Signals use the past only, so each point is
    computed once over the whole panel; a block takes the `warmup` bars before it as
    context and drops as many at its beginning as are missing there.  All folds
    and points are one plan, keyed by both.  With log, the path of a trial log,
    every point is logged as one trial, however many folds there are: the grid is what was tried.
    """
    out = _scores(_blocks(panel, factory, points, train, test, step, warmup, cost_bps, lag))
    if log:
        config = {"train": train, "test": test, "step": step or test, "cost_bps": cost_bps, "lag": lag, "warmup": warmup, "n_grid_points": len(points)}
        rows = out.groupBy("point").agg(F.avg("test_sharpe").alias("sharpe"), F.count(F.lit(1)).alias("folds"), F.max(F.when(F.col("fold") == 0, F.col("selected"))).alias("selected")).collect()
        of = {r.point: r for r in rows}
        trials = []
        for i, p in enumerate(points):
            r = of.get(i)
            sharpe = r.sharpe if r else None
            found = {"sharpe_per_period": None if sharpe is None else sharpe / math.sqrt(252.0), "sharpe_ann": sharpe, "n_periods": test * (r.folds if r else 0)}
            trials.append((config | {"params": p, "selected": bool(r and r.selected), "n_folds": r.folds if r else 0}, found))
        log_trials(panel.sparkSession, log, "walk_forward_grid_point", trials, at)
    return out


def walk_forward_book(panel: DataFrame, factory, points: list[dict[str, Any]], train: int = 504, test: int = 126, step: int | None = None, warmup: int = 0, cost_bps: float = 2.0, lag: int = 1) -> DataFrame:
    """The stitched out-of-sample book: fold, point, ts, bar_idx and net of the selected point's test bars, fold after fold."""
    book = _blocks(panel, factory, points, train, test, step, warmup, cost_bps, lag)
    chosen = _scores(book).where("selected").select("fold", "point")
    return book.where("kind = 'test'").join(chosen, ["fold", "point"]).select("fold", "point", "ts", "bar_idx", "net")


def parameter_stability(folds_: DataFrame, grid_size: int) -> DataFrame:
    """Entropy of the selected points (0: always the same, 1: uniform over the grid), the modal share and a verdict."""
    chosen = folds_.where("selected").groupBy("point").count()
    total = F.sum("count").over(Window.partitionBy())
    share = chosen.withColumn("p", F.col("count") / total)
    out = share.agg((-F.sum(F.col("p") * F.ln("p")) / math.log(max(grid_size, 2))).alias("entropy"), F.max("p").alias("modal_share"), F.count(F.lit(1)).alias("n_distinct"))
    return out.withColumn("verdict", F.when(F.col("entropy") < 0.3, "stable").when(F.col("entropy") < 0.7, "mixed").otherwise("unstable"))


def purged_kfold(samples: DataFrame, n: int, splits: int = 5, embargo: int = 0, horizon: int = 1, index: str = "idx") -> DataFrame:
    """fold, index and role (train or test) of every sample that a fold uses.

    Training samples less than `horizon` bars before the test block, or less
    than `embargo` after it, are left out.  Labels of the last test samples
    reach past the block: use an embargo of at least horizon - 1.
    """
    if splits < 2 or n < splits or embargo < 0 or horizon < 1:
        raise ValueError("need splits >= 2, n >= splits, embargo >= 0 and horizon >= 1")
    bounds = [n * k // splits for k in range(splits + 1)]
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:]))])).alias("f")
    x = F.col(index)
    role = F.when((x >= F.col("lo")) & (x < F.col("hi")), "test").when((x < F.col("lo") - (horizon - 1)) | (x >= F.col("hi") + embargo), "train")
    return samples.select(index, cells).select(index, "f.*").withColumn("role", role).where("role IS NOT NULL").select("fold", index, "role")


def jsonable(x: Any) -> Any:
    """x for JSON: numbers that aren't finite become null, other objects text."""
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [jsonable(v) for v in x]
    if isinstance(x, (bool, str, type(None))):
        return x
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return float(x) if math.isfinite(x) else None
    return str(x)


def log_trial(spark: SparkSession, path: str, kind: str, config: dict, results: dict, at: str) -> None:
    """Append one line (timestamp, kind, config, metrics) to the trial log, a folder of JSON lines."""
    log_trials(spark, path, kind, [(config, results)], at)


def log_trials(spark: SparkSession, path: str, kind: str, trials: list[tuple[dict, dict]], at: str) -> None:
    """One line for each pair of config and metrics, in one append."""
    lines = [(json.dumps({"timestamp": at, "kind": kind, "config": jsonable(c), "metrics": jsonable(m)}, sort_keys=True),) for c, m in trials]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, kind, config (JSON) and metrics of all lines; a line that can't be parsed is a trial without fields."""
    kind = "timestamp string, kind string, metrics map<string,double>"
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", kind).alias("x"), F.get_json_object("value", "$.config").alias("config")).select("x.*", "config")


def trial_count(trials: DataFrame) -> int:
    return trials.count()


def trial_sharpes(trials: DataFrame, per_year: float = 252.0) -> DataFrame:
    """sharpe per period of the trials that have one, from the annual one where only that is logged."""
    m = F.col("metrics")
    sr = F.coalesce(F.try_element_at(m, F.lit("sharpe_per_period")), F.try_element_at(m, F.lit("sharpe_ann")) / math.sqrt(per_year))
    return trials.select(sr.alias("sharpe")).where("sharpe IS NOT NULL")


def current_threshold(trials: DataFrame, n_periods: int, per_year: float = 252.0) -> dict[str, float]:
    """The Sharpe ratio that luck alone reaches after all logged trials."""
    own = [r.sharpe for r in trial_sharpes(trials, per_year).collect()]
    n = trial_count(trials)
    variance = metrics.sharpe_variance(own)
    variance = 1 / max(n_periods - 1, 1) if math.isnan(variance) else variance
    per_period = metrics.expected_max_sharpe(n, variance)
    return {"n_trials": n, "variance": variance, "threshold_per_period": per_period, "threshold_annual": per_period * math.sqrt(per_year)}
