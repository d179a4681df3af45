"""All registered tests of a registry in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import validate
from tidemark.operators.inference import adjust_p_values, compute_ic, demean
from tidemark.operators.metrics import normal_two_sided
from tidemark.operators.signals import SIGNALS
from tidemark.plans.panel import forward_returns
from tidemark.sources import registry

OVERNIGHT = "the horizon leaves the session"


def run_grid(spark: SparkSession, panel: DataFrame, document: dict, session_length: int | None = 390, entry_lag: int = 1, residualise: bool = True, fft: bool | None = None, log: str | None = None, at: str = "") -> DataFrame:
    """One row for each hypothesis and horizon: the IC, the raw one, the one without entry lag, and adjusted p-values.

    panel: symbol, ts, bar_idx, px and, if horizons shall stay within it, session.
    With log, the path of a trial log, every test is logged as one trial.
    """
    keys = ("hypothesis_id", "signal_name", "variant")
    by_horizon: dict[int, list[DataFrame]] = {}
    notes, signals = [], []
    for e in document["hypotheses"]:
        signal = SIGNALS[e["signal"]](**e["params"])(panel).persist()
        signals.append(signal)
        for h in e["horizons_bars"]:
            registry.require(document, e["signal"], h, e["params"])
            within = session_length is not None and h + entry_lag <= session_length - 1 and "session" in panel.columns
            notes.append((e["id"], h, None if within or session_length is None else OVERNIGHT))
            named = lambda df, v: df.select(F.lit(e["id"]).alias(keys[0]), F.lit(e["signal"]).alias(keys[1]), F.lit(v).alias(keys[2]), "ts", "bar_idx", "symbol", "signal", "fwd")  # noqa: E731, B023
            cells, lag0 = (forward_returns(signal, h, k, "session" if within else None) for k in (entry_lag, 0))
            main, zero = (demean(x) if residualise else x for x in (cells, lag0))
            by_horizon.setdefault(h, []).extend([named(main, "main"), named(cells, "raw"), named(zero, "lag0")])
    # one plan for each horizon, which sets the lags; hypotheses and variants are keys in it
    every = reduce(DataFrame.unionByName, [compute_ic(reduce(DataFrame.unionByName, parts), h, False, keys=keys, fft=fft) for h, parts in by_horizon.items()]).persist()
    of = lambda v: every.where(F.col("variant") == v).drop("variant")
    on = ["hypothesis_id", "signal_name", "horizon"]
    raw = of("raw").select(*on, F.col("ic").alias("ic_raw"), F.col("t_hac").alias("t_hac_raw"))
    zero = of("lag0").select(*on, F.col("ic").alias("ic_entry_lag0"))
    note = spark.createDataFrame(notes, "hypothesis_id string, horizon int, note string")
    results = of("main").join(raw, on).join(zero, on).join(note, ["hypothesis_id", "horizon"]).withColumnRenamed("signal_name", "signal")
    # a row for each registered test; the normal tail is taken on the driver
    got = results.collect()
    rows = [(*r, None if r.t_hac is None else normal_two_sided(r.t_hac)) for r in got]
    schema = T.StructType([*results.schema.fields, T.StructField("p_value", T.DoubleType())])
    for held in (every, *signals):
        held.unpersist()
    if log:
        params = {e["id"]: e["params"] for e in document["hypotheses"]}
        found = [r.asDict() | {"p_value": row[-1]} for r, row in zip(got, rows)]
        # an information coefficient has no Sharpe ratio
        trials = [({"hypothesis_id": r["hypothesis_id"], "signal": r["signal"], "params": params[r["hypothesis_id"]], "horizon_bars": r["horizon"], "residualised": residualise}, {k: r.get(k) for k in ("ic", "t_hac", "p_value", "n_effective", "n")} | {"sharpe_per_period": None}) for r in found]
        validate.log_trials(spark, log, "ic", trials, at)
    return adjust_p_values(spark.createDataFrame(rows, schema))


def ranking(results: DataFrame) -> DataFrame:
    """The tests by adjusted p-value; results without the adjustment aren't ranked."""
    if "p_value_by" not in results.columns:
        raise ValueError("adjust the p-values before ranking")
    return results.orderBy(F.col("p_value_by").asc_nulls_last(), "hypothesis_id", "horizon")


def survivors(results: DataFrame, alpha: float = 0.05, method: str = "by") -> DataFrame:
    return ranking(results).where(F.col(f"p_value_{method}") < alpha)


def summary_line(results: DataFrame, alpha: float = 0.05, method: str = "by") -> str:
    n, k = results.where("p_value IS NOT NULL").count(), survivors(results, alpha, method).count()
    return f"{k} of {n} tests have an adjusted p-value ({method}) below {alpha}"
