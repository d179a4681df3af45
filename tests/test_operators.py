"""Properties of the operators: causality, budgets, statistics with known answers, generators, stores and streams."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import allocator, engine, inference, metrics, regime, sizing, validate
from tidemark.operators.signals import SIGNALS, default_signals
from tidemark.plans import panel as P
from tidemark.plans.api import Api, Config
from tidemark.sources import registry, simulate, store
from tidemark.streaming import bars as streaming


@pytest.fixture(scope="module")
def prices(spark):
    return simulate.gbm(spark, 320, 3, [7], correlation=0.3).select("symbol", "ts", "bar_idx", "px").persist()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def perturbed(prices, after):
    return prices.withColumn("px", F.when(F.col("bar_idx") > after, F.col("px") * (1 + F.rand(3))).otherwise(F.col("px")))


@pytest.mark.parametrize("signal", default_signals(), ids=lambda s: s.name)
def test_signals_see_the_past_only(spark, prices, signal):
    head = lambda p: rows(signal(p).where("bar_idx <= 200"), "symbol", "bar_idx", "signal")
    base = head(prices)
    assert head(perturbed(prices, 200)) == base
    assert head(prices.where("bar_idx <= 230")) == base  # appending bars changes nothing
    values = [x for *_, x in rows(signal(prices), "symbol", "bar_idx", "signal") if x is not None]
    assert values and all(-1 <= x <= 1 for x in values)


@pytest.mark.parametrize("tier", [0, 1, 2, 3])
def test_regimes_see_the_past_only(spark, prices, tier):
    head = lambda p: rows(regime.classify(p, tier, min_periods=60, allow_tier3=True).where("bar_idx <= 200").withColumn("regime", F.coalesce("regime", F.lit("-"))), "bar_idx", "regime")
    assert head(perturbed(prices, 200)) == head(prices)


def test_a_leak_is_seen(spark, prices):
    leak = lambda p: rows(p.withColumn("x", F.lead("px").over(P.by_symbol())).where("bar_idx <= 200"), "symbol", "bar_idx", "x")
    assert leak(perturbed(prices, 200)) != leak(prices)


def test_tier3_must_be_asked_for(prices):
    with pytest.raises(ValueError):
        regime.classify(prices, 3)


def test_expanding_quantiles_agree_on_both_paths(spark, monkeypatch):
    rng = np.random.default_rng(1)
    series = spark.createDataFrame([(i, float(x) if i % 9 else None) for i, x in enumerate(rng.normal(size=300))], "bar_idx long, v double")
    short = rows(regime.expanding_quantiles(series, "v", [0.33, 0.5], 20).na.fill(-99), "bar_idx", "q0", "q1")
    monkeypatch.setattr(regime, "EXACT_ROWS", 10)
    long_ = rows(regime.expanding_quantiles(series, "v", [0.33, 0.5], 20).na.fill(-99), "bar_idx", "q0", "q1")
    assert np.allclose(short, long_)


def test_signal_binding():
    s = SIGNALS["ma_crossover"](fast=5)
    assert s.lookback == 50 and s.label == "ma_crossover(fast=5, slow=50)" and SIGNALS["vol_breakout"](window=9).lookback == 10
    with pytest.raises(TypeError):
        SIGNALS["ma_crossover"](quick=5)
    with pytest.raises(ValueError):
        SIGNALS["ma_crossover"](fast=50, slow=10)(None)


def plain_budget(targets, budget, cost, edge, dead=0.05):
    book, out, day, left = {}, [], None, budget
    for ts, wanted in targets:
        if ts.date() != day:
            day, left = ts.date(), budget
        moves = []
        for s, x in wanted.items():
            d = 0.0 if x is None else x - book.get(s, 0.0)
            v = abs(d) * (edge - cost) / 1e4
            if abs(d) > dead and v > 0:
                moves.append((-v, s, x))
        for _, s, x in sorted(moves)[:left]:
            book[s] = x
        left -= len(sorted(moves)[:left])
        out += [(ts, s, book.get(s, 0.0)) for s in wanted]
    return sorted(out)


@pytest.fixture(scope="module")
def hourly_targets():
    rng = np.random.default_rng(2)
    start = dt.datetime(2020, 1, 1)
    return [(start + dt.timedelta(hours=h), {f"a{i}": None if rng.random() < 0.1 else float(round(rng.uniform(-1, 1), 1)) for i in range(6)}) for h in range(120)]


def test_trade_budget(spark, hourly_targets):
    flat = [("b", ts, i, s, x) for i, (ts, w) in enumerate(hourly_targets) for s, x in w.items()]
    targets = spark.createDataFrame(flat, "book string, ts timestamp, bar_idx long, symbol string, desired double")
    got = allocator.trade_budget(targets, 3, 2.0).persist()
    assert sorted((r.ts, r.symbol, r.position) for r in got.collect()) == plain_budget(hourly_targets, 3, 2.0, 5.0)
    used = [r.budget_used for r in allocator.budget_used(got).collect()]
    assert max(used) == 3 and len(used) == 5
    assert {r.reason for r in got.select("reason").distinct().collect()} <= {"executed", "budget_exhausted", "below_min_trade_size", "negative_expected_value"}
    assert allocator.trade_budget(targets, 3, 9.0).where("executed").count() == 0  # trades that cost more than their edge


def test_trade_budget_stream(spark, hourly_targets, tmp_path):
    rows_ = [("b", ts, w) for ts, w in hourly_targets]
    table = spark.createDataFrame(rows_, "book string, ts timestamp, desired map<string,double>")
    table.where("ts < '2020-01-03'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = streaming.budget_stream(stream, 3, 2.0).writeStream.format("memory").queryName("budget").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    table.where("ts >= '2020-01-03'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert sorted((r.ts, r.symbol, r.position) for r in spark.table("budget").collect()) == plain_budget(hourly_targets, 3, 2.0, 5.0)


def test_select_trades_breaks_ties_by_name(spark):
    one = spark.createDataFrame([("t", f"a{i}", 1.0, 0.0, 5e-4) for i in (3, 10, 2, 1)] + [("t", "b", None, 0.4, 5e-4), ("t", "c", 0.01, 0.0, 5e-4), ("t", "d", 1.0, 0.0, 1e-4)], "ts string, symbol string, desired double, current double, edge double")
    got = {r.symbol: r.reason for r in allocator.select_trades(one, 2, 2.0).collect()}
    assert got == {"a1": "executed", "a10": "executed", "a2": "budget_exhausted", "a3": "budget_exhausted", "b": "below_min_trade_size", "c": "below_min_trade_size", "d": "negative_expected_value"}


def test_weights(spark):
    labels = spark.createDataFrame([(0, 0, "trend"), (1, 1, None), (2, 2, "odd")], "ts long, bar_idx long, regime string")
    got = {(r.bar_idx, r.strategy): r.weight for r in allocator.regime_weights(labels, {"trend": {"x": 0.9, "y": 0.1}}, ["x", "y"]).collect()}
    assert got == {(0, "x"): 0.9, (0, "y"): 0.1, (1, "x"): 0.5, (1, "y"): 0.5, (2, "x"): 0.5, (2, "y"): 0.5}
    with pytest.raises(ValueError):
        allocator.regime_weights(labels, {"trend": {"z": 1.0}}, ["x", "y"])
    with pytest.warns(UserWarning):
        allocator.regime_weights(labels, {"trend": {"x": 1.0}}, ["x", "y"])
    assert len(allocator.tier3_weights()) == 12 and all(math.isclose(sum(w.values()), 1) for w in allocator.tier3_weights().values())
    compound = spark.createDataFrame([(0, 0, "low_vol|trend|ac+"), (1, 1, "low_vol|odd|ac+")], "ts long, bar_idx long, regime string")
    assert allocator.weight_coverage(compound, {"trend": {}}).first()[0] == 0.5


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([(i, x) for i, x in enumerate([0.01, -0.005, 0.02, 0.0, -0.01])], "ts int, net double")
    s = metrics.summary(r).first()
    assert s.sharpe_per_period == pytest.approx(0.24913644) and s.sharpe == pytest.approx(3.95491837) and s.hit_rate == 0.5
    assert s.max_drawdown == pytest.approx(-0.01)
    pos = spark.createDataFrame([(s, i, float(x)) for s, v in {"a": [0, 1, 1, 0], "b": [0, 0, 1, 1]}.items() for i, x in enumerate(v)], "symbol string, bar_idx long, position double")
    assert metrics.turnover(pos).first()[0] == pytest.approx(252.0)
    assert metrics.expected_max_sharpe(1, 1.0) == 0 and 1.5 < metrics.expected_max_sharpe(10, 1.0) < 1.6
    assert metrics.probabilistic_sharpe(0.1, 1000, 0, 3) > 0.99 > metrics.deflated_sharpe(0.05, 250, 0, 3, 100)
    assert regime.hypothesis_cost(5, 4, 2500)["multiplier"] == pytest.approx(1.594, abs=1e-3)
    assert sizing.kelly(0.1, 0.2) == pytest.approx(0.625)


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, None]
    got = {r.id: (r.p_value_bh, r.p_value_by) for r in inference.adjust_p_values(spark.createDataFrame(list(enumerate(p)), "id int, p_value double")).collect()}
    bh = [0.025, 0.05, 0.05, 0.025, 0.5]
    h = sum(1 / k for k in range(1, 6))
    assert [got[i][0] for i in range(5)] == pytest.approx(bh) and [got[i][1] for i in range(5)] == pytest.approx([min(1, x * h) for x in bh]) and got[5] == (None, None)


def test_newey_west_paths_agree(spark):
    rng = np.random.default_rng(3)
    x = np.convolve(rng.normal(size=400), np.ones(5), "valid")
    series = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "bar_idx long, m double")
    e, n = x - x.mean(), len(x)
    lrv = sum((1 if k == 0 else 2 * (1 - k / 13)) * (e[k:] * e[: n - k]).sum() for k in range(13))
    want = math.sqrt(lrv) / n
    assert inference.newey_west(series, "m", 12).first().se == pytest.approx(want) == inference.newey_west_fft(series, "m", 12).first().se


def test_planted_information_is_found(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(400, 8))
    cells = [(f"s{j}", i, i, float(z[i, j]), float(0.2 * z[i, j] + rng.normal())) for i in range(400) for j in range(8)]
    df = spark.createDataFrame(cells, "symbol string, ts long, bar_idx long, signal double, fwd double")
    got = inference.compute_ic(df, 1).first()
    assert got.ic == pytest.approx(0.19, abs=0.05) and got.t_hac > 5 and got.n_raw == 3200
    flat = inference.compute_ic(df.withColumn("signal", F.lit(1.0)), 1).first()
    assert flat.ic is None and flat.t_hac is None


def test_forward_returns_stay_in_the_session(spark):
    cells = [(s, d * 390 + m, d * 390 + m, d, float(100 + d * 390 + m)) for s in ("A", "B") for d in range(3) for m in range(390)]
    p = spark.createDataFrame(cells, "symbol string, ts long, bar_idx long, session int, px double")
    for h, lag in ((30, 1), (130, 1), (30, 0)):
        assert P.forward_returns(p, h, lag, "session").where("fwd IS NOT NULL").count() == 3 * (390 - h - lag) * 2
    first = P.forward_returns(p, 10, 1).where("symbol = 'A' AND bar_idx = 0").first().fwd
    assert first == pytest.approx(111 / 101 - 1)


def test_purged_kfold(spark):
    got = validate.purged_kfold(spark.range(100).withColumnRenamed("id", "idx"), 100, 5, 5, 3).where("fold = 2 AND role = 'train'")
    left = {r.idx for r in got.collect()}
    assert left == set(range(0, 38)) | set(range(65, 100))


def test_costs_are_paid_once(spark, prices):
    held = engine.backtest(SIGNALS["always_long"]()(prices), cost_bps=10.0)
    assert held.agg(F.sum("cost")).first()[0] == 0
    paid = engine.backtest(SIGNALS["always_long"]()(prices), cost_bps=10.0, charge_entry=True)
    assert paid.agg(F.sum("cost")).first()[0] == pytest.approx(3 * 10 / 1e4)
    with pytest.raises(ValueError):
        engine.asset_backtest(prices, lag=0)
    with pytest.raises(ValueError):
        engine.check_symbols(prices, prices.withColumn("symbol", F.lit("none")))


def test_generators(spark):
    g = simulate.gbm(spark, 800, 2, [1, 2], sigma=0.2, correlation=0.5)
    r = P.log_returns(g.withColumn("symbol", F.concat_ws("/", "symbol", "seed"))).toPandas()
    wide = r.pivot(index="bar_idx", columns="symbol", values="lret").dropna()
    assert wide.std().mean() * math.sqrt(252) == pytest.approx(0.2, rel=0.08)
    assert wide.corr().loc["asset_0/1", "asset_1/1"] == pytest.approx(0.5, abs=0.1) and abs(wide.corr().loc["asset_0/1", "asset_0/2"]) < 0.15
    assert rows(simulate.gbm(spark, 50, 2, [1]), "symbol", "bar_idx", "px") == rows(simulate.gbm(spark, 90, 2, [1]).where("bar_idx < 50"), "symbol", "bar_idx", "px")
    ou = simulate.ornstein_uhlenbeck(spark, 1500, 1, [5], half_life=10).orderBy("bar_idx").toPandas()["px"].map(math.log)
    assert math.log(0.5) / math.log(ou.autocorr()) == pytest.approx(10, rel=0.6)
    garch = simulate.garch_t(spark, 1500, 1, [3]).orderBy("bar_idx").toPandas()["px"].map(math.log).diff().dropna()
    assert garch.kurt() > 1
    states = simulate.regime_switching(spark, 600, 2, [4], with_states=True).toPandas()
    assert set(states["state"]) == {"trend", "chop"} and len(states) == 1200
    with pytest.raises(ValueError):
        simulate.shocks(spark, [1], 5, 3, -0.6)
    with pytest.raises(ValueError):
        simulate.garch_t(spark, 5, 1, alpha=0.5, beta=0.6)
    assert pd.DatetimeIndex(simulate.business_days(spark, 10).toPandas()["ts"]).dayofweek.max() < 5


def test_bar_store(spark, tmp_path):
    path = str(tmp_path / "bars")
    one = [(dt.datetime(2024, 1, d, 15, m), s, 1.0, 2.0, 0.5, 1.5, 10.0, 3.0, 1.2, "sip", {"z": 0.1 * m}) for d in (2, 3) for m in range(4) for s in ("A", "B")]
    names = "timestamp timestamp, symbol string, open double, high double, low double, close double, volume double, trade_count double, vwap double, feed string, signals map<string,double>"
    s = store.BarStore(spark, path)
    s.append(spark.createDataFrame(one[:8], names))
    s.append(spark.createDataFrame(one[8:], names).drop("signals"))
    assert s.load().count() == 16 and "signal_z" in s.load().columns
    some = s.load("2024-01-03", "2024-01-03", ["A"], ["timestamp", "close"])
    assert some.columns == ["timestamp", "close"] and some.count() == 4 and "PartitionFilters: [isnotnull" in some._jdf.queryExecution().toString()
    assert {(r.symbol, r.bars) for r in s.summary().collect()} == {("A", 8), ("B", 8)}
    assert s.forward_returns(1).count() == 2 * 2 * 2
    with pytest.raises(ValueError):
        s.append(spark.createDataFrame([(1,)], "x int"))


def test_calendar_feed_retry_and_source(spark):
    days = store.calendar(spark, "2024-07-01", "2024-07-07", ("2024-07-04",), ("2024-07-03",))
    assert [(r.session.day, r.minutes) for r in days.orderBy("session").collect()] == [(1, 390), (2, 390), (3, 210), (5, 390)]
    assert store.clock(days, dt.datetime(2024, 7, 1, 15, 0)).first().is_open
    now = dt.datetime(2024, 7, 1, 12)
    store.check_feed("sip", now - dt.timedelta(minutes=16), now)
    for bad in (("sip", now), ("iex", now), ("x", now)):
        with pytest.raises(ValueError):
            store.check_feed(*bad, now)
    fails = iter([1, 1, 0])

    def call():
        if next(fails):
            raise OSError
        return "ok"

    assert store.retry(call, sleep=lambda s: None) == "ok"
    spark.dataSource.register(store.bar_source(lambda symbols, start, end: [(dt.datetime(2024, 1, 1), s, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "sip") for s in symbols], "test_bars"))
    assert spark.read.format("test_bars").option("symbols", "A,B,C").option("chunk", "2").load().count() == 3
    plan = store.backfill_plan(spark, dt.date(2024, 1, 15), dt.date(2024, 3, 2), list("abcde"), 2)
    assert plan.count() == 9 and store.backfill_plan(spark, dt.date(2024, 1, 15), dt.date(2024, 3, 2), list("abcde"), 2, plan.limit(4)).count() == 5
    funds = spark.createDataFrame([("Vanguard X",), ("Acme Corp",), ("SuperETF Inc",), ("My ETF",), (None,)], "n string").select(store.is_fund(F.col("n")).alias("f")).collect()
    assert [r.f for r in funds] == [True, False, True, True, False] or [r.f for r in funds] == [True, False, False, True, False]


def test_registry_and_trial_log(spark, tmp_path):
    from tidemark.plans.queries import REGISTRY

    document = registry.check(REGISTRY)
    assert registry.table(spark, document).count() == 8 and registry.budget_remaining(document)["remaining"] == 22
    assert registry.require(document, "vol_breakout", 5)["id"] == "T2"
    with pytest.raises(ValueError):
        registry.require(document, "vol_breakout", 7)
    out = registry.verdicts(document, [{"hypothesis_id": "T0", "p_value_by": 0.01, "ic": -0.2}, {"hypothesis_id": "T1", "p_value_by": 0.01, "ic": 0.2}, {"hypothesis_id": "T2", "p_value_by": 0.5, "ic": 1}])
    assert out["T0"].endswith("reversed") and out["T1"].startswith("supported") and out["T2"].startswith("falsified")
    log = str(tmp_path / "log")
    for k in range(3):
        validate.log_trial(spark, log, "backtest", {"k": k, "bad": float("nan")}, {"sharpe_ann": 1.0 + k}, f"2024-01-0{k + 1}")
    (tmp_path / "log" / "broken.txt").write_text("{not json\n")
    trials = validate.read_trials(spark, log)
    assert validate.trial_count(trials) == 4 and validate.trial_sharpes(trials).count() == 3
    assert validate.current_threshold(trials, 2500)["threshold_annual"] > 0
    texts = spark.createDataFrame([("IC <= 0",), ("IC > 0.02",), ("indistinguishable from zero, IC > 0",), ("?",)], "t string")
    assert [r[0] for r in texts.select(scalars.predicted_direction("t")).collect()] == ["non_positive", "positive", "null", "null"]


def test_streaming_bars_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    made = streaming.windowed_bars(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    query = streaming.append_to_store(made, str(tmp_path / "store"), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    out = spark.read.parquet(str(tmp_path / "store"))
    batch = streaming.windowed_bars(events.withColumn("ts", F.col("ts").cast("timestamp")))
    last = out.agg(F.max("ts")).first()[0]
    # the stream holds back windows that the watermark hasn't passed
    assert rows(out, "ts", "symbol", "open", "close", "volume") == rows(batch.where(F.col("ts") <= F.lit(last)), "ts", "symbol", "open", "close", "volume")


def test_sessions(spark):
    api = Api(spark)
    assert api.health() == {"status": "ok", "sessions": 0} and api.defaults()["tier"] == 0
    with pytest.raises(ValueError):
        Config(n_steps=5)
    made = api.create(n_steps=330, n_assets=2, generator="gbm")
    seen = api.tick(made["id"], 20)
    assert seen["cursor"] == made["warmup"] + 20 and not seen["done"] and len(seen["strategies"]) == 9
    assert api.tick(made["id"], 10_000)["done"]
    assert api.delete(made["id"]) and api.health()["sessions"] == 0


@pytest.mark.parametrize(
    "returns, total, drawdown, calmar",
    [
        ([0.1, -1.0, 0.05, 0.02], -1.0, -1.0, -math.inf),
        ([0.1, -1.5, 0.05], 1.1 * -0.5 * 1.05 - 1, None, -math.inf),
        ([0.1, float("nan"), -0.05, float("inf"), None], 1.1 * 0.95 - 1, -0.05, None),
        ([0.1], 0.1, 0.0, "null"),
    ],
)
def test_metrics_of_lost_and_undefined_returns(spark, returns, total, drawdown, calmar):
    own = [x for x in returns if x is not None and math.isfinite(x)]
    df = spark.createDataFrame(list(enumerate(returns)), "ts int, net double")
    s = metrics.summary(df).first()
    assert s.n_periods == len(returns) and s.n_returns == len(own)
    assert s.total_return == pytest.approx(total) and s.mean_annual == pytest.approx(np.mean(own) * 252)
    if drawdown is not None:
        assert s.max_drawdown == pytest.approx(drawdown) and metrics.max_drawdown(df).first()[0] == pytest.approx(drawdown)
    if calmar == "null":
        assert s.calmar is None and s.sharpe is None and s.sortino is None
    elif calmar is not None:
        assert s.calmar == calmar
    else:
        assert s.calmar == pytest.approx(((1 + total) ** (252 / len(own)) - 1) / abs(drawdown))


def test_walk_forward_logs_a_trial_for_each_point(spark, prices, tmp_path):
    """A sweep costs as many trials as it has points, and raises the threshold for all later results."""
    log = str(tmp_path / "trials")
    points = validate.grid(window=[5, 10, 20])
    run = lambda p: validate.walk_forward(prices, SIGNALS["zscore_reversion"], p, 100, 40, None, 20, log=log, at="2024-01-01")
    folds = run(points).where("selected").count()
    assert validate.trial_count(validate.read_trials(spark, log)) == 3
    before = validate.current_threshold(validate.read_trials(spark, log), 300)["n_trials"]
    run(points)
    assert before == 3 and validate.trial_count(validate.read_trials(spark, log)) == 6
    book = validate.walk_forward_book(prices, SIGNALS["zscore_reversion"], points, 100, 40, None, 20)
    assert book.count() == folds * 40 == book.select("bar_idx").distinct().count()


def test_grid_logs_its_tests(spark, prices, tmp_path):
    from tidemark.plans import ic_grid
    from tidemark.plans.queries import REGISTRY

    log = str(tmp_path / "trials")
    grid = ic_grid.run_grid(spark, prices, REGISTRY, session_length=None, log=log, at="2024-01-01")
    trials = validate.read_trials(spark, log)
    assert validate.trial_count(trials) == grid.count() == 8 and validate.trial_sharpes(trials).count() == 0


def test_regimes_begin_with_their_long_run_share(spark):
    first = simulate.regime_switching(spark, 3, 1, list(range(300)), p_stay_trend=0.99, p_stay_chop=0.9, with_states=True).where("bar_idx = 0")
    assert 0.84 < first.where("state = 'trend'").count() / 300 < 0.97  # (1 - 0.9) / (0.01 + 0.1)
    with pytest.raises(ValueError):
        simulate.regime_switching(spark, 3, p_stay_trend=1.2)


def test_signal_parameters_are_checked():
    with pytest.raises(ValueError):
        SIGNALS["zscore_reversion"](window=1)
    assert SIGNALS["random_signal"]().label == "random_signal(seed=0)" and SIGNALS["always_long"]().label == "always_long()"
