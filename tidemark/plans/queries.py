"""The named queries over the test tables, and their DuckDB twins.

Panels: `daily` has a day and a return flag with line status as symbol,
price = value over quantity of line items; `hourly` has an hour and an event
type, with bars of the events' values.  Both are put on the full grid and
filled forward (hourly: within the session).  Results are rounded to 6 digits, as sums of
doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import allocator, engine, inference, metrics, regime, sizing, validate
from tidemark.operators.signals import SIGNALS
from tidemark.plans import panel as P
from tidemark.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def half_away(c: str, digits: int) -> Column:
    """Rounding by binary arithmetic, as the twins do it (Spark's own rounds the decimal digits)."""
    scale = 10.0**digits
    v = F.abs(c) * scale
    return F.signum(c) * F.when(v < 4e15, F.floor(F.when(v < 4e15, v) + 0.5).cast("double")).otherwise(v) / scale + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without negative zeros, and timestamps as text."""
    kind = {"double": lambda c: half_away(c, digits).alias(c), "timestamp": lambda c: F.col(c).cast("string").alias(c), "timestamp_ntz": lambda c: F.col(c).cast("string").alias(c), "date": lambda c: F.col(c).cast("string").alias(c)}
    return df.select(*[kind.get(t, F.col)(c) for c, t in df.dtypes])


def daily_cells(spark: SparkSession, sf: str) -> DataFrame:
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.groupBy(F.col("l_shipdate").alias("ts"), F.concat("l_returnflag", "l_linestatus").alias("symbol")).agg((money("l_extendedprice") / money("l_quantity")).alias("px"), money("l_quantity").alias("volume"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return P.forward_fill(P.densify(daily_cells(spark, sf))).select("ts", "bar_idx", "symbol", "px", "volume")


def hourly_bars(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    return P.bars(events, "hour", "ts", "event_type", "value", "event_id")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return store.session_filled_panel(hourly_bars(spark, sf), "close")


#: Common table expressions of the twins.
DAILY = """
cells AS (SELECT l_shipdate AS ts, l_returnflag || l_linestatus AS symbol, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS px0, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2),
grid AS (SELECT ts, bar_idx, symbol FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar_idx FROM (SELECT DISTINCT ts FROM cells)), (SELECT DISTINCT symbol FROM cells)),
dense AS (SELECT grid.ts, bar_idx, grid.symbol, px0, volume FROM grid LEFT JOIN cells ON cells.ts = grid.ts AND cells.symbol = grid.symbol),
panel AS (SELECT ts, bar_idx, symbol, volume, last_value(px0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx) AS px FROM dense),
rets AS (SELECT *, px / nullif(lag(px) OVER s, 0) - 1 AS ret, ln(px) - ln(lag(px) OVER s) AS lret FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY bar_idx))"""
HOURLY = """
bars AS (SELECT date_trunc('hour', ts) AS ts, event_type AS symbol, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(value) AS volume FROM events GROUP BY 1, 2),
grid AS (SELECT ts, bar_idx, symbol FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar_idx FROM (SELECT DISTINCT ts FROM bars)), (SELECT DISTINCT symbol FROM bars)),
hraw AS (SELECT grid.ts, bar_idx, grid.symbol, close AS px0, CAST((grid.ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS session FROM grid LEFT JOIN bars ON bars.ts = grid.ts AND bars.symbol = grid.symbol),
hpanel AS (SELECT ts, bar_idx, symbol, session, last_value(px0 IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY bar_idx) AS px FROM hraw)"""


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def frame(n: int, name: str = "w", last: str = "CURRENT ROW") -> str:
    return f"{name} AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n} PRECEDING AND {last})"


# --- panels -----------------------------------------------------------------


@query("spine", f"WITH {DAILY} SELECT CAST(ts AS VARCHAR) AS ts, bar_idx, symbol, {r('px0', 'px')} FROM dense")
def spine(spark, sf):
    return rounded(P.densify(daily_cells(spark, sf)).select("ts", "bar_idx", "symbol", "px"))


@query("simple_return", f"WITH {DAILY} SELECT bar_idx, symbol, {r('ret', 'ret')} FROM rets")
def simple_return(spark, sf):
    return rounded(P.simple_returns(daily(spark, sf)).select("bar_idx", "symbol", "ret"))


@query("log_return", f"WITH {DAILY} SELECT bar_idx, symbol, {r('lret', 'lret')} FROM rets")
def log_return(spark, sf):
    return rounded(P.log_returns(daily(spark, sf)).select("bar_idx", "symbol", "lret"))


@query("bars_ohlcv", f"WITH {HOURLY} SELECT CAST(ts AS VARCHAR) AS ts, symbol, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, volume FROM bars")
def bars_ohlcv(spark, sf):
    return rounded(hourly_bars(spark, sf))


@query("session_id", f"WITH {HOURLY} SELECT CAST(session AS VARCHAR) AS session, count(*) AS cells, count(DISTINCT ts) AS bars FROM hraw GROUP BY 1")
def session_id(spark, sf):
    cells = P.densify(hourly_bars(spark, sf)).withColumn("session", P.session_id(F.col("ts")).cast("string"))
    return cells.groupBy("session").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("ts").alias("bars"))


@query("session_ffill", f"WITH {HOURLY} SELECT CAST(ts AS VARCHAR) AS ts, symbol, {r('px', 'px')} FROM hpanel")
def session_ffill(spark, sf):
    return rounded(hourly(spark, sf).select("ts", "symbol", "px"))


@query("regular_hours", "SELECT event_type AS symbol, count(*) AS n FROM events WHERE hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') * 60 + minute((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') BETWEEN 570 AND 959 GROUP BY 1")
def regular_hours(spark, sf):
    return P.regular_hours(spark.read.parquet(f"{sf}/events.parquet")).groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query("pivot_panel", f"WITH {DAILY} SELECT bar_idx, {', '.join(r(f'max(px) FILTER (WHERE symbol = {chr(39)}{s}{chr(39)})', s) for s in ('AF', 'NO', 'RF'))} FROM panel GROUP BY bar_idx")
def pivot_panel(spark, sf):
    own = daily(spark, sf)
    wide = P.wide(own, "px", ["AF", "NO", "RF"]).join(own.select("ts", "bar_idx").distinct(), "ts")
    return rounded(wide.select("bar_idx", "AF", "NO", "RF"))


@query("unpivot_panel", f"WITH {DAILY} SELECT CAST(ts AS VARCHAR) AS ts, symbol, {r('px', 'px')} FROM panel WHERE px IS NOT NULL AND symbol IN ('AF', 'NO')")
def unpivot_panel(spark, sf):
    return rounded(P.unpivot(P.wide(daily(spark, sf), "px", ["AF", "NO"]), ["AF", "NO"]))


#: Every symbol of the daily panel, for twins that name columns.
SYMBOLS = ("AF", "AO", "NF", "NO", "RF", "RO")


@query("pivot_panel_all", f"WITH {DAILY} SELECT bar_idx, {', '.join(r(f'max(px) FILTER (WHERE symbol = {chr(39)}{s}{chr(39)})', s) for s in SYMBOLS)} FROM panel GROUP BY bar_idx")
def pivot_panel_all(spark, sf):
    own = daily(spark, sf)
    wide = P.wide(own, "px").join(own.select("ts", "bar_idx").distinct(), "ts")
    return rounded(wide.drop("ts"))


@query("unpivot_panel_all", f"WITH {DAILY} SELECT CAST(ts AS VARCHAR) AS ts, symbol, {r('px', 'px')} FROM panel WHERE px IS NOT NULL")
def unpivot_panel_all(spark, sf):
    wide = P.wide(daily(spark, sf), "px")
    return rounded(P.unpivot(wide, [c for c in wide.columns if c != "ts"]))


@query("downsample", f"WITH {DAILY}, m AS (SELECT ts, avg(px) AS px, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM panel GROUP BY ts) SELECT CAST(ts AS VARCHAR) AS ts, {r('px', 'px')} FROM m WHERE k % greatest(1, n // 220) = 0 OR k = n - 1")
def downsample(spark, sf):
    market = daily(spark, sf).groupBy("ts").agg(F.avg("px").alias("px"))
    return rounded(P.downsample(market, 220))


@query("forward_return", f"WITH {HOURLY}, f AS (SELECT *, lead(px, 4) OVER s / nullif(lead(px, 1) OVER s, 0) - 1 AS x, lead(session, 4) OVER s AS s4 FROM hpanel WINDOW s AS (PARTITION BY symbol ORDER BY bar_idx)) SELECT bar_idx, symbol, {r('CASE WHEN s4 = session THEN x END', 'fwd')} FROM f")
def forward_return(spark, sf):
    return rounded(P.forward_returns(hourly(spark, sf), 3, 1, "session").select("bar_idx", "symbol", "fwd"))


@query(
    "purged_forward",
    f"WITH {HOURLY}, f AS (SELECT *, lead(px, 4) OVER s / nullif(lead(px, 1) OVER s, 0) - 1 AS x, lead(session, 4) OVER s AS s4, max(bar_idx) OVER () AS m FROM hpanel WINDOW s AS (PARTITION BY symbol ORDER BY bar_idx)), t AS (SELECT DISTINCT ts, bar_idx FROM hpanel) SELECT f.bar_idx, f.symbol, {r('x', 'fwd')}, CAST(t.ts AS VARCHAR) AS embargo_until FROM f JOIN t ON t.bar_idx = least(f.bar_idx + 8, f.m) WHERE s4 = session AND x IS NOT NULL",
)
def purged_forward(spark, sf):
    own = P.purged_forward_returns(hourly(spark, sf), 3, 5, 1, "session")
    return rounded(own.select("bar_idx", "symbol", "fwd", "embargo_until"))


# --- signals ----------------------------------------------------------------


def z_sql(n: int) -> str:
    return f"lz AS (SELECT *, CASE WHEN count(ln(px)) OVER w = {n} THEN CASE WHEN stddev_samp(ln(px)) OVER w = 0 THEN 0 ELSE (ln(px) - avg(ln(px)) OVER w) / stddev_samp(ln(px)) OVER w END END AS z FROM rets WINDOW {frame(n - 1)})"


def clip_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, -1), 1) END"


@query("rolling_z", f"WITH {DAILY}, {z_sql(20)} SELECT bar_idx, symbol, {r('z', 'z')} FROM lz")
def rolling_z(spark, sf):
    from tidemark.operators.signals import rolling_z as z

    return rounded(z(daily(spark, sf), 20).select("bar_idx", "symbol", "z"))


def signal_query(name: str, sql: str, **params):
    @query(name, sql)
    def run(spark, sf):
        return rounded(SIGNALS[name](**params)(daily(spark, sf)).select("bar_idx", "symbol", "signal"))


signal_query("zscore_reversion", f"WITH {DAILY}, {z_sql(20)} SELECT bar_idx, symbol, {r(clip_sql('-z / 2.0'), 'signal')} FROM lz")
signal_query("zscore_momentum", f"WITH {DAILY}, {z_sql(60)} SELECT bar_idx, symbol, {r(clip_sql('z / 2.0'), 'signal')} FROM lz")
signal_query("timeseries_momentum", f"WITH {DAILY} SELECT bar_idx, symbol, CAST(sign(ln(px) - ln(lag(px, 60) OVER (PARTITION BY symbol ORDER BY bar_idx))) AS DOUBLE) + 0.0 AS signal FROM panel")
signal_query("ma_crossover", f"WITH {DAILY} SELECT bar_idx, symbol, CAST(sign(CASE WHEN count(px) OVER f = 10 THEN avg(px) OVER f END - CASE WHEN count(px) OVER w = 50 THEN avg(px) OVER w END) AS DOUBLE) + 0.0 AS signal FROM panel WINDOW {frame(9, 'f')}, {frame(49)}")
BREAKOUT = f"""ch AS (SELECT *, CASE WHEN count(px) OVER w = 20 THEN max(px) OVER w END AS hi, CASE WHEN count(px) OVER w = 20 THEN min(px) OVER w END AS lo FROM panel WINDOW {frame(20, 'w', '1 PRECEDING')}),
br AS (SELECT *, CASE WHEN px > hi THEN 1.0 WHEN px < lo THEN -1.0 END AS b FROM ch),
bo AS (SELECT *, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx), CASE WHEN hi IS NOT NULL THEN 0.0 END) AS signal FROM br)"""
signal_query("vol_breakout", f"WITH {DAILY}, {BREAKOUT} SELECT bar_idx, symbol, CAST(signal AS DOUBLE) + 0.0 AS signal FROM bo")
RANDOM = "2.0 * (CAST(('0x' || substr(md5('0|' || bar_idx || '|' || symbol), 1, 8)) AS BIGINT) / 4294967295.0) - 1.0"
signal_query("random_signal", f"WITH {DAILY} SELECT bar_idx, symbol, {r(RANDOM, 'signal')} FROM panel", seed=0)
signal_query("always_long", f"WITH {DAILY} SELECT bar_idx, symbol, CAST(1.0 AS DOUBLE) AS signal FROM panel")


# --- regimes ----------------------------------------------------------------

VOL = f"""v0 AS (SELECT *, CASE WHEN count(lret) OVER w = 20 THEN stddev_samp(lret) OVER w END * sqrt(252.0) AS v FROM rets WINDOW {frame(19)}),
mv AS (SELECT ts, bar_idx, avg(v) AS vol FROM v0 GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN count(vol) OVER e >= 126 THEN quantile_cont(vol, 0.33) OVER e END AS q0, CASE WHEN count(vol) OVER e >= 126 THEN quantile_cont(vol, 0.67) OVER e END AS q1 FROM mv WINDOW e AS (ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
vr AS (SELECT ts, bar_idx, CASE WHEN vol >= q1 THEN 'high_vol' WHEN vol <= q0 THEN 'low_vol' WHEN vol IS NOT NULL AND q0 IS NOT NULL THEN 'normal_vol' END AS regime FROM q)"""
ER = f"""e0 AS (SELECT *, CASE WHEN count(lret) OVER w = 20 THEN abs(sum(lret) OVER w) / nullif(sum(abs(lret)) OVER w, 0) END AS er1 FROM rets WINDOW {frame(19)}),
me AS (SELECT ts, bar_idx, avg(er1) AS er FROM e0 GROUP BY 1, 2),
qe AS (SELECT *, CASE WHEN count(er) OVER e >= 126 THEN quantile_cont(er, 0.5) OVER e END AS q0 FROM me WINDOW e AS (ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
tr AS (SELECT ts, bar_idx, CASE WHEN er >= q0 THEN 'trend' WHEN er < q0 THEN 'chop' END AS regime FROM qe)"""
AC = f"""a0 AS (SELECT *, lag(lret) OVER (PARTITION BY symbol ORDER BY bar_idx) AS r1 FROM rets),
a1 AS (SELECT *, CASE WHEN count(lret + r1) OVER w = 60 THEN corr(lret, r1) OVER w END AS ac1 FROM a0 WINDOW {frame(59)}),
ma AS (SELECT ts, bar_idx, avg(CASE WHEN NOT isnan(ac1) THEN ac1 END) AS ac FROM a1 GROUP BY 1, 2)"""
TIER3 = "t3 AS (SELECT vr.ts, vr.bar_idx, CASE WHEN vr.regime IS NOT NULL AND tr.regime IS NOT NULL AND ma.ac IS NOT NULL THEN vr.regime || '|' || tr.regime || '|' || CASE WHEN ma.ac >= 0 THEN 'ac+' ELSE 'ac-' END END AS regime FROM vr JOIN tr USING (bar_idx) JOIN ma USING (bar_idx))"


@query("market_series", f"WITH {DAILY} SELECT bar_idx, {r('avg(lret)', 'lret')} FROM rets GROUP BY 1")
def market_series(spark, sf):
    return rounded(regime.market_series(P.log_returns(daily(spark, sf)), "lret").select("bar_idx", "lret"))


@query("realized_vol", f"WITH {DAILY}, {VOL} SELECT bar_idx, symbol, {r('v', 'vol')} FROM v0")
def realized_vol(spark, sf):
    return rounded(regime.realized_vol(daily(spark, sf)).select("bar_idx", "symbol", "vol"))


@query("efficiency_ratio", f"WITH {DAILY}, {ER} SELECT bar_idx, {r('er', 'er')} FROM me")
def efficiency_ratio(spark, sf):
    return rounded(regime.efficiency_ratio(daily(spark, sf)).select("bar_idx", "er"))


@query("autocorr_regime", f"WITH {DAILY}, {AC} SELECT bar_idx, {r('ac', 'ac')} FROM ma")
def autocorr_regime(spark, sf):
    return rounded(regime.autocorrelation(daily(spark, sf)).select("bar_idx", "ac"))


@query("vol_regime", f"WITH {DAILY}, {VOL} SELECT bar_idx, regime FROM vr")
def vol_regime(spark, sf):
    return regime.vol_regime(daily(spark, sf)).select("bar_idx", "regime")


@query("regime_tier2", f"WITH {DAILY}, {ER} SELECT bar_idx, regime FROM tr")
def regime_tier2(spark, sf):
    return regime.classify(daily(spark, sf), 2).select("bar_idx", "regime")


@query("regime_tier3", f"WITH {DAILY}, {VOL}, {ER}, {AC}, {TIER3} SELECT bar_idx, regime FROM t3")
def regime_tier3(spark, sf):
    return regime.classify(daily(spark, sf), 3, allow_tier3=True).select("bar_idx", "regime")


@query("regime_counts", f"WITH {DAILY}, {ER} SELECT regime, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')}, {r('sqrt(252.0 / count(*))', 'sharpe_se')} FROM tr WHERE regime IS NOT NULL GROUP BY 1")
def regime_counts(spark, sf):
    return rounded(regime.sample_counts(regime.classify(daily(spark, sf), 2)))


@query(
    "regime_bands",
    f"WITH {DAILY}, {VOL}, c AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY bar_idx) > 1 AND regime IS NOT DISTINCT FROM lag(regime) OVER (ORDER BY bar_idx) THEN 0 ELSE 1 END AS ch FROM vr), b AS (SELECT *, sum(ch) OVER (ORDER BY bar_idx) AS band FROM c) SELECT CAST(band AS BIGINT) AS band, regime, CAST(min(ts) AS VARCHAR) AS start_ts, CAST(max(ts) AS VARCHAR) AS end_ts, count(*) AS bars FROM b GROUP BY band, regime",
)
def regime_bands(spark, sf):
    return rounded(regime.bands(regime.vol_regime(daily(spark, sf))))


STRATEGIES = list(allocator.DEFAULT_WEIGHTS["trend"])
WEIGHTS = "weights AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{s}', {w})" for g, v in allocator.DEFAULT_WEIGHTS.items() for s, w in v.items()) + ") AS x(regime, strategy, weight)), strategies AS (SELECT DISTINCT strategy FROM weights), bw AS (SELECT tr.ts, tr.bar_idx, strategies.strategy, coalesce(CAST(weights.weight AS DOUBLE), 0.2) AS weight FROM tr CROSS JOIN strategies LEFT JOIN weights ON weights.regime = tr.regime AND weights.strategy = strategies.strategy)"


@query("regime_weights", f"WITH {DAILY}, {ER}, {WEIGHTS} SELECT bar_idx, strategy, {r('weight', 'weight')} FROM bw")
def regime_weights(spark, sf):
    return rounded(allocator.regime_weights(regime.classify(daily(spark, sf), 2), allocator.DEFAULT_WEIGHTS, STRATEGIES).select("bar_idx", "strategy", "weight"))


@query("resolve_weights", f"WITH {DAILY}, {VOL}, {ER}, {AC}, {TIER3} SELECT DISTINCT regime AS label, string_split(regime, '|')[2] AS source FROM t3 WHERE regime IS NOT NULL")
def resolve_weights(spark, sf):
    return allocator.resolve_weights(regime.classify(daily(spark, sf), 3, allow_tier3=True), allocator.DEFAULT_WEIGHTS)


T3_VALUES = "(VALUES " + ", ".join(f"('{v}|{t}|{a}', '{s}', {w}, {p}, {1.6 if (s in allocator.REVERSION) == (a == 'ac-') else 1.0})" for v, p in zip(regime.VOL_LABELS, (0.5, 1.0, 1.5)) for t in regime.TREND_LABELS for a in regime.SIGN_LABELS for s, w in allocator.DEFAULT_WEIGHTS[t].items()) + ") AS x(regime, strategy, w, p, tilt)"


@query("tier3_weights", f"SELECT regime, strategy, {r('pow(w * tilt, p) / sum(pow(w * tilt, p)) OVER (PARTITION BY regime)', 'weight')} FROM {T3_VALUES}")
def tier3_weights(spark, sf):
    return rounded(allocator.weight_table(spark, allocator.tier3_weights(), STRATEGIES))


@query("prediction_parser", "SELECT item AS text, CASE WHEN contains(lower(item), 'indistinguishable from zero') OR contains(lower(item), '= 0 within') OR contains(lower(item), '= 0 by construction') THEN 'null' WHEN contains(lower(item), '<= 0') THEN 'non_positive' WHEN contains(lower(item), 'ic > ') OR contains(lower(item), '> 0') THEN 'positive' ELSE 'null' END AS direction FROM (SELECT DISTINCT 'IC ' || CASE p_size % 4 WHEN 0 THEN '> 0.0' WHEN 1 THEN '<= 0, size ' WHEN 2 THEN '= 0 within ' ELSE 'unknown ' END || p_size AS item FROM part)")
def prediction_parser(spark, sf):
    size = F.col("p_size")
    text = F.concat(F.lit("IC "), F.when(size % 4 == 0, "> 0.0").when(size % 4 == 1, "<= 0, size ").when(size % 4 == 2, "= 0 within ").otherwise("unknown "), size.cast("string"))
    return spark.read.parquet(f"{sf}/part.parquet").select(text.alias("text")).distinct().withColumn("direction", scalars.predicted_direction("text"))


# --- books ------------------------------------------------------------------

SIGS = f"{z_sql(20)}, sg AS (SELECT ts, bar_idx, symbol, px, ret, {clip_sql('-z / 2.0')} AS signal FROM lz)"
CELLS = """h AS (SELECT *, lag(signal) OVER (PARTITION BY symbol ORDER BY bar_idx) AS held FROM sg),
cell AS (SELECT *, held * ret AS gross, abs(held - lag(held) OVER (PARTITION BY symbol ORDER BY bar_idx)) AS turnover FROM h),
cellc AS (SELECT *, turnover * 2.0 / 1e4 AS cost, gross - coalesce(turnover * 2.0 / 1e4, 0) AS net FROM cell),
book AS (SELECT ts, bar_idx, sum(gross) AS gross, sum(cost) AS cost, sum(turnover) AS turnover, count(*) FILTER (WHERE turnover > 1e-4) AS trades, sum(gross) - coalesce(sum(cost), 0) AS net FROM cellc WHERE bar_idx >= 20 GROUP BY 1, 2)"""
BOOK = f"WITH {DAILY}, {SIGS}, {CELLS}"


def signalled(spark, sf) -> DataFrame:
    return SIGNALS["zscore_reversion"]()(daily(spark, sf))


def book(spark, sf) -> DataFrame:
    return engine.backtest(signalled(spark, sf), cost_bps=2.0, warmup=20)


@query("backtest_net", f"{BOOK} SELECT CAST(ts AS VARCHAR) AS ts, bar_idx, {r('gross', 'gross')}, {r('cost', 'cost')}, {r('turnover', 'turnover')}, trades, {r('net', 'net')} FROM book")
def backtest_net(spark, sf):
    return rounded(book(spark, sf))


@query("asset_net", f"{BOOK} SELECT bar_idx, symbol, {r('held', 'held')}, {r('net', 'net')} FROM cellc WHERE bar_idx >= 20")
def asset_net(spark, sf):
    return rounded(engine.asset_backtest(signalled(spark, sf), cost_bps=2.0, warmup=20).select("bar_idx", "symbol", "held", "net"))


@query("trade_counts", f"{BOOK} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(trades) AS BIGINT) AS trades FROM book GROUP BY 1")
def trade_counts(spark, sf):
    return rounded(engine.daily_trades(book(spark, sf)))


EQ = "small AS (SELECT * REPLACE (net / 1000 AS net) FROM book), eq AS (SELECT *, exp(sum(ln(1 + coalesce(net, 0))) OVER (ORDER BY ts)) AS equity FROM small), dd AS (SELECT *, equity / max(equity) OVER (ORDER BY ts) - 1 AS drawdown FROM eq)"


def scaled(spark, sf) -> DataFrame:
    """The book at a thousandth of its size: the daily panel's jumps would overflow a compounded curve."""
    return book(spark, sf).withColumn("net", F.col("net") / 1000)


@query("equity_curve", f"{BOOK}, {EQ} SELECT bar_idx, {r('equity', 'equity')}, {r('drawdown', 'drawdown')} FROM dd")
def equity_curve(spark, sf):
    return rounded(metrics.equity(scaled(spark, sf)).select("bar_idx", "equity", "drawdown"))


SUMMARY = f"""s AS (SELECT count(*) AS n_periods, count(net) AS n_returns, avg(net) * 252 AS mean_annual, stddev_samp(net) * sqrt(252.0) AS vol_annual, avg(net) / stddev_samp(net) * sqrt(252.0) AS sharpe, avg(net) / stddev_samp(net) AS sharpe_per_period, avg(net) / sqrt(avg(CASE WHEN net IS NOT NULL THEN pow(least(net, 0), 2) END)) * sqrt(252.0) AS sortino, min(drawdown) AS max_drawdown, count(*) FILTER (WHERE net > 0) / count(*) FILTER (WHERE net <> 0) AS hit_rate, arg_max(equity, ts) - 1 AS total_return, skewness(net) AS skew, kurtosis(net) + 3 AS kurtosis FROM dd)
SELECT n_periods, n_returns, {', '.join(r(c, c, 5) for c in ('mean_annual', 'vol_annual', 'sharpe', 'sharpe_per_period', 'sortino', 'max_drawdown', 'hit_rate', 'skew', 'kurtosis'))}, {r('ln(1 + total_return)', 'log_total', 5)}, {r('(pow(1 + total_return, 252.0 / n_returns) - 1) / abs(max_drawdown)', 'calmar', 3)} FROM s"""


@query("summary_metrics", f"{BOOK}, {EQ}, {SUMMARY}")
def summary_metrics(spark, sf):
    s = metrics.summary(scaled(spark, sf))
    head = s.select("n_periods", "n_returns", "mean_annual", "vol_annual", "sharpe", "sharpe_per_period", "sortino", "max_drawdown", "hit_rate", "skew", "kurtosis", F.log1p("total_return").alias("log_total"))
    return rounded(head, 5).join(rounded(s.select("calmar"), 3))


WIPED = "small AS (SELECT * REPLACE (CASE WHEN bar_idx % 97 = 5 THEN CAST('nan' AS DOUBLE) WHEN bar_idx = 60 THEN CAST('inf' AS DOUBLE) WHEN bar_idx = 900 THEN -1.0 ELSE net / 1000 END AS net) FROM book), clean AS (SELECT ts, bar_idx, CASE WHEN isfinite(net) THEN net END AS net FROM small), eq AS (SELECT *, product(1 + coalesce(net, 0)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM clean), dd AS (SELECT *, equity / max(equity) OVER (ORDER BY ts) - 1 AS drawdown FROM eq)"


def wiped(spark, sf) -> DataFrame:
    """The scaled book with undefined returns and a bar that loses everything."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    net = F.when(F.col("bar_idx") % 97 == 5, nan).when(F.col("bar_idx") == 60, inf).when(F.col("bar_idx") == 900, -1.0).otherwise(F.col("net"))
    return scaled(spark, sf).withColumn("net", net)


@query("equity_total_loss", f"{BOOK}, {WIPED} SELECT bar_idx, {r('equity', 'equity')}, {r('drawdown', 'drawdown')} FROM dd")
def equity_total_loss(spark, sf):
    return rounded(metrics.equity(wiped(spark, sf)).select("bar_idx", "equity", "drawdown"))


@query("summary_total_loss", f"{BOOK}, {WIPED} SELECT count(*) AS n_periods, count(net) AS n_returns, {r('min(drawdown)', 'max_drawdown')}, {r('arg_max(equity, ts) - 1', 'total_return')}, CAST('-inf' AS DOUBLE) AS calmar, {r('avg(net) / stddev_samp(net) * sqrt(252.0)', 'sharpe')}, {r('count(*) FILTER (WHERE net > 0) / count(*) FILTER (WHERE net <> 0)', 'hit_rate')} FROM dd")
def summary_total_loss(spark, sf):
    s = metrics.summary(wiped(spark, sf))
    return rounded(s.drop("calmar").select("n_periods", "n_returns", "max_drawdown", "total_return", "sharpe", "hit_rate")).join(s.select("calmar"))


@query("turnover_annual", f"{BOOK}, t AS (SELECT bar_idx, sum(abs(d)) AS d FROM (SELECT bar_idx, signal - lag(signal) OVER (PARTITION BY symbol ORDER BY bar_idx) AS d FROM sg) GROUP BY 1) SELECT {r('avg(d) * 252', 'turnover', 4)} FROM t WHERE bar_idx > 0")
def turnover_annual(spark, sf):
    return rounded(metrics.turnover(signalled(spark, sf), column="signal"), 4)


@query(
    "round_trips",
    f"{BOOK}, sd AS (SELECT *, sign(coalesce(held, 0)) AS side FROM cellc), ch AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER (PARTITION BY symbol ORDER BY bar_idx) THEN 1 ELSE 0 END AS c FROM sd), rn AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY bar_idx) AS run FROM ch) SELECT symbol, CAST(side AS DOUBLE) AS side, CAST(min(ts) AS VARCHAR) AS opened, CAST(max(ts) AS VARCHAR) AS closed, count(*) AS bars, {r('sum(gross)', 'pnl')}, {r('sum(coalesce(cost, 0))', 'cost')} FROM rn WHERE side <> 0 GROUP BY symbol, run, side",
)
def round_trips(spark, sf):
    return rounded(engine.round_trips(engine.asset_backtest(signalled(spark, sf), cost_bps=2.0)))


COMBINED = f"{SIGS}, mom AS (SELECT bar_idx, symbol, CAST(sign(ln(px) - ln(lag(px, 60) OVER (PARTITION BY symbol ORDER BY bar_idx))) AS DOUBLE) AS signal FROM panel), cb AS (SELECT sg.ts, sg.bar_idx, sg.symbol, sg.ret, coalesce(sg.signal, 0) * 0.5 + coalesce(mom.signal, 0) * 0.5 AS position FROM sg JOIN mom USING (bar_idx, symbol))"
PVOL = "g AS (SELECT ts, bar_idx, sum(l * ret) AS g FROM (SELECT *, lag(position) OVER (PARTITION BY symbol ORDER BY bar_idx) AS l FROM cb) GROUP BY 1, 2), sd AS (SELECT *, CASE WHEN count(g) OVER w = 60 THEN stddev_samp(g) OVER w END AS sd FROM g WINDOW w AS (ORDER BY bar_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), pv AS (SELECT ts, bar_idx, lag(sd) OVER (ORDER BY bar_idx) * sqrt(252.0) AS vol FROM sd)"


def combined(spark, sf) -> DataFrame:
    from tidemark.plans.portfolio import targets

    own = P.simple_returns(daily(spark, sf))
    names = ["zscore_reversion", "timeseries_momentum"]
    weights = allocator.regime_weights(regime.classify(own, 0), {}, names)
    return allocator.combine(targets(own, [SIGNALS[n]() for n in names]), weights).join(own.select("bar_idx", "symbol", "ret"), ["bar_idx", "symbol"])


@query("combine", f"WITH {DAILY}, {COMBINED} SELECT bar_idx, symbol, {r('position', 'position')} FROM cb")
def combine(spark, sf):
    return rounded(combined(spark, sf).select("bar_idx", "symbol", "position"))


@query("portfolio_vol", f"WITH {DAILY}, {COMBINED}, {PVOL} SELECT bar_idx, {r('vol', 'vol')} FROM pv")
def portfolio_vol(spark, sf):
    return rounded(sizing.portfolio_vol(combined(spark, sf)).select("bar_idx", "vol"))


@query("vol_target", f"WITH {DAILY}, {COMBINED}, {PVOL} SELECT cb.bar_idx, symbol, {r('position * coalesce(CASE WHEN vol > 0 THEN least(0.1 / vol, 3.0) END, 0)', 'position')} FROM cb LEFT JOIN pv USING (bar_idx)")
def vol_target(spark, sf):
    return rounded(sizing.vol_target(combined(spark, sf)).select("bar_idx", "symbol", "position"))


SELECT = f"""t AS (SELECT CAST(ts AS VARCHAR) AS ts, symbol, round(coalesce(signal, 0), 9) AS delta, abs(round(coalesce(signal, 0), 9)) * (5.0 / 1e4 - 2.0 / 1e4) AS value FROM sg),
e AS (SELECT *, abs(delta) > 0.05 AS big, abs(delta) > 0.05 AND value > 0 AS ok FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY ts, ok ORDER BY value DESC, symbol) AS rk FROM e)"""


@query("select_trades", f"WITH {DAILY}, {SIGS}, {SELECT} SELECT ts, symbol, {r('delta', 'delta')}, ok AND rk <= 3 AS executed, CASE WHEN ok AND rk <= 3 THEN 'executed' WHEN ok THEN 'budget_exhausted' WHEN NOT big THEN 'below_min_trade_size' ELSE 'negative_expected_value' END AS reason FROM k")
def select_trades(spark, sf):
    rows = signalled(spark, sf).select("ts", "symbol", half_away("signal", 9).alias("desired"), F.lit(0.0).alias("current"), (F.lit(5.0) / 1e4).alias("edge"))
    return rounded(allocator.select_trades(rows, 3, 2.0).select("ts", "symbol", "delta", "executed", "reason"))


def budgeted(spark, sf) -> DataFrame:
    # targets on a fixed grid, so that no decision hangs on the last digits
    rows = signalled(spark, sf).select(F.lit("book").alias("book"), F.col("ts").cast("timestamp").alias("ts"), "bar_idx", "symbol", F.round("signal", 3).alias("desired"))
    return allocator.trade_budget(rows, 3, 2.0)


#: The budget bar by bar: lists in the order of symbols are the state, and the trades left on the day.
BUDGET = """tg AS (SELECT ts, bar_idx, symbol, round(signal, 3) AS desired FROM sg),
bars AS (SELECT bar_idx, max(ts) AS ts, max(CAST(ts AS DATE)) AS d, list(desired ORDER BY symbol) AS want, list(symbol ORDER BY symbol) AS names, range(1, count(*) + 1) AS places FROM tg GROUP BY bar_idx),
rec AS (
  SELECT CAST(-1 AS BIGINT) AS b, CAST(NULL AS DATE) AS d, (SELECT list_transform(places, lambda i: CAST(0 AS DOUBLE)) FROM bars WHERE bar_idx = 0) AS cur, CAST(3 AS BIGINT) AS room, CAST([] AS DOUBLE[]) AS delta, CAST([] AS DOUBLE[]) AS val, CAST([] AS BOOLEAN[]) AS done
  UNION ALL
  SELECT b, d, list_transform(places, lambda i: CASE WHEN done[i] THEN goal[i] ELSE cur[i] END), room - len(list_filter(done, lambda x: x)), delta, val, done FROM (
    SELECT *, list_transform(places, lambda i: ok[i] AND len(list_filter(places, lambda j: ok[j] AND (val[j] > val[i] OR (val[j] = val[i] AND j < i)))) < room) AS done FROM (
      SELECT *, list_transform(places, lambda i: abs(delta[i]) > 0.05 AND val[i] > 0) AS ok FROM (
        SELECT *, list_transform(delta, lambda x: abs(x) * (5.0 / 1e4 - 2.0 / 1e4)) AS val FROM (
          SELECT *, list_transform(places, lambda i: goal[i] - cur[i]) AS delta FROM (
            SELECT bars.bar_idx AS b, bars.d, cur, CASE WHEN bars.d = rec.d THEN room ELSE 3 END AS room, places, list_transform(places, lambda i: coalesce(want[i], cur[i])) AS goal
            FROM rec JOIN bars ON bars.bar_idx = rec.b + 1)))))
),
bd AS (SELECT 'book' AS book, bars.ts, bars.bar_idx, unnest(names) AS symbol, unnest(cur) AS position, unnest(delta) AS delta, unnest(val) AS value, unnest(done) AS executed FROM rec JOIN bars ON bar_idx = b),
dc AS (SELECT *, CASE WHEN executed THEN 'executed' WHEN abs(delta) > 0.05 AND value > 0 THEN 'budget_exhausted' WHEN abs(delta) <= 0.05 THEN 'below_min_trade_size' ELSE 'negative_expected_value' END AS reason FROM bd)"""
BUDGETED = f"WITH RECURSIVE {DAILY}, {SIGS}, {BUDGET}"


@query("trade_budget", f"{BUDGETED} SELECT book, CAST(ts AS VARCHAR) AS ts, bar_idx, symbol, {r('position', 'position')}, {r('delta', 'delta')}, {r('value', 'value')}, executed, reason FROM dc")
def trade_budget(spark, sf):
    return rounded(budgeted(spark, sf))


@query("budget_used", f"{BUDGETED} SELECT book, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE executed) AS budget_used FROM dc GROUP BY 1, 2")
def budget_used(spark, sf):
    return rounded(allocator.budget_used(budgeted(spark, sf)))


@query("rejection_reasons", f"{BUDGETED} SELECT reason, count(*) AS count FROM dc WHERE NOT executed GROUP BY 1")
def rejection_reasons(spark, sf):
    return allocator.rejection_reasons(budgeted(spark, sf))


# --- inference --------------------------------------------------------------

FWD = "fw AS (SELECT *, lead(px, 6) OVER s / nullif(lead(px, 1) OVER s, 0) - 1 AS fwd0 FROM sg WINDOW s AS (PARTITION BY symbol ORDER BY bar_idx)), fd AS (SELECT *, fwd0 - avg(fwd0) OVER (PARTITION BY ts) AS fwd FROM fw)"
PROD = "ok AS (SELECT * FROM fd WHERE signal IS NOT NULL AND fwd IS NOT NULL), mo AS (SELECT avg(signal) AS ms, stddev_pop(signal) AS ss, avg(fwd) AS mf, stddev_pop(fwd) AS sf FROM ok), x AS (SELECT ts, bar_idx, symbol, (signal - ms) / ss * (fwd - mf) / sf AS x FROM ok, mo)"
NW = "pm AS (SELECT bar_idx, avg(x) AS m, count(*) AS c FROM x GROUP BY 1), pe AS (SELECT m - avg(m) OVER () AS e, row_number() OVER (ORDER BY bar_idx) AS k, count(*) OVER () AS n FROM pm WHERE c >= 2), lr AS (SELECT sum(CASE WHEN l = 0 THEN 1.0 ELSE 2.0 * (1 - l / 11.0) END * a.e * b.e) AS lrv, sum(CASE WHEN l = 0 THEN a.e * a.e END) AS g0, max(a.n) AS n FROM pe a, unnest(range(0, 11)) AS u(l) JOIN pe b ON b.k = a.k + l), se AS (SELECT n, CASE WHEN lrv > 0 THEN sqrt(lrv) / n ELSE sqrt(g0 / (n - 1) / n) END AS se FROM lr)"
NW = NW.replace("FROM pe a, unnest(range(0, 11)) AS u(l) JOIN pe b ON b.k = a.k + l", "FROM pe a CROSS JOIN (SELECT unnest(range(0, 11)) AS l) u JOIN pe b ON b.k = a.k + u.l")
IC = f"WITH {DAILY}, {SIGS}, {FWD}, {PROD}, {NW}"


def cells(spark, sf, lag: int = 1) -> DataFrame:
    return P.forward_returns(signalled(spark, sf), 5, lag).select("ts", "bar_idx", "symbol", "px", "signal", "fwd")


@query("demean", f"{IC} SELECT bar_idx, symbol, {r('fwd', 'fwd')} FROM fd")
def demean(spark, sf):
    return rounded(inference.demean(cells(spark, sf)).select("bar_idx", "symbol", "fwd"))


@query(
    "rolling_beta",
    f"WITH {DAILY}, m AS (SELECT *, avg(ret) OVER (PARTITION BY ts) AS market FROM rets), b AS (SELECT *, CASE WHEN count(ret + market) OVER w >= 30 THEN covar_samp(CASE WHEN ret IS NOT NULL THEN market END, ret) OVER w / nullif(var_samp(CASE WHEN ret IS NOT NULL THEN market END) OVER w, 0) END AS beta FROM m WINDOW {frame(60, 'w', '1 PRECEDING')}) SELECT bar_idx, symbol, {r('beta', 'beta')}, {r('ret - beta * market', 'resid')} FROM b",
)
def rolling_beta(spark, sf):
    own = inference.rolling_beta_residual(P.simple_returns(daily(spark, sf)), 60)
    return rounded(own.select("bar_idx", "symbol", "beta", "resid"))


@query("pairwise_corr", f"WITH {DAILY} SELECT a.symbol AS a, b.symbol AS b, {r('corr(a.ret, b.ret)', 'corr')} FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2")
def pairwise_corr(spark, sf):
    return rounded(inference.pairwise_correlation(P.simple_returns(daily(spark, sf))))


@query("breadth", f"WITH {DAILY}, c AS (SELECT corr(a.ret, b.ret) AS c FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.symbol, b.symbol), k AS (SELECT CAST(count(DISTINCT symbol) AS DOUBLE) AS n, (SELECT avg(c) FROM c) AS rho FROM rets) SELECT n, {r('rho', 'rho')}, {r('n / (1 + (n - 1) * rho)', 'n_eff')} FROM k")
def breadth(spark, sf):
    return rounded(inference.breadth(P.simple_returns(daily(spark, sf))))


@query("newey_west_se", f"{IC} SELECT n, {r('se', 'se', 8)} FROM se")
def newey_west_se(spark, sf):
    x = inference.products(inference.demean(cells(spark, sf)))
    mean = x.groupBy("bar_idx").agg(F.avg("x").alias("m"), F.count("x").alias("c")).where("c >= 2")
    return rounded(inference.newey_west(mean, "m", 10), 8)


@query("newey_west_fft", f"{IC} SELECT n, {r('se', 'se', 8)} FROM se")
def newey_west_fft(spark, sf):
    x = inference.products(inference.demean(cells(spark, sf)))
    mean = x.groupBy("bar_idx").agg(F.avg("x").alias("m"), F.count("x").alias("c")).where("c >= 2")
    return rounded(inference.newey_west_fft(mean, "m", 10), 8)


@query(
    "compute_ic",
    f"{IC}, po AS (SELECT avg(x) AS ic, stddev_samp(x) AS sd, count(x) AS n_raw, count(DISTINCT symbol) AS n_symbols FROM x), ca AS (SELECT stddev_samp(m) / sqrt(count(*)) AS ca FROM (SELECT avg(x) AS m FROM x GROUP BY symbol)) SELECT n_raw, n_symbols, se.n AS n_periods, {r('ic', 'ic')}, {r('se.se', 'se_dk')}, {r('ca', 'se_cluster_asset')}, {r('ic / se.se', 't_hac')}, {r('ic / sqrt((1 - ic * ic) / (n_raw - 2))', 't_iid')}, {r('pow(sd / se.se, 2)', 'n_effective', 2)}, {r('pow(se.se / (sd / sqrt(n_raw)), 2)', 'variance_inflation')}, {r('n_raw / 5.0', 'n_effective_naive')} FROM po, se, ca",
)
def compute_ic(spark, sf):
    ic = inference.compute_ic(cells(spark, sf), 5)
    own = ic.select("n_raw", "n_symbols", "n_periods", "ic", "se_dk", "se_cluster_asset", "t_hac", "t_iid", "variance_inflation", "n_effective_naive")
    return rounded(own).join(rounded(ic.select("n_effective"), 2))


@query(
    "newey_west_panel",
    f"""WITH {DAILY}, {SIGS}, {FWD}, {PROD},
ne AS (SELECT symbol, bar_idx, x - avg(x) OVER (PARTITION BY symbol) AS e, count(*) OVER (PARTITION BY symbol) AS n FROM x),
cv AS (SELECT a.symbol, max(a.n) AS n, sum(CASE WHEN l = 0 THEN 1.0 ELSE 2.0 * (1 - l / 11.0) END * a.e * b.e) AS s, sum(CASE WHEN l = 0 THEN a.e * b.e END) AS s0 FROM ne a CROSS JOIN (SELECT unnest(range(0, 11)) AS l) u JOIN ne b ON b.symbol = a.symbol AND b.bar_idx = a.bar_idx + u.l GROUP BY 1),
vv AS (SELECT n, greatest(s, s0) / n / n AS v, n / sum(n) OVER () AS w FROM cv WHERE n > 12)
SELECT {r('sqrt(sum(w * w * v))', 'se_newey_west')} FROM vv""",
)
def newey_west_panel(spark, sf):
    return rounded(inference.newey_west_panel(inference.products(inference.demean(cells(spark, sf))), 10))


@query("ic_pearson", f"WITH {DAILY}, {SIGS}, fw AS (SELECT *, lead(px, 2) OVER s / lead(px, 1) OVER s - 1 AS fwd FROM sg WINDOW s AS (PARTITION BY symbol ORDER BY bar_idx)) SELECT count(*) AS n, {r('corr(signal, fwd)', 'ic')} FROM fw WHERE symbol = 'NO' AND signal IS NOT NULL AND fwd IS NOT NULL")
def ic_pearson(spark, sf):
    own = P.forward_returns(signalled(spark, sf), 1).where("symbol = 'NO'")
    return rounded(inference.information_coefficient(own).select("n", "ic"))


@query(
    "ic_spearman",
    f"WITH {DAILY}, {SIGS}, fw AS (SELECT *, lead(px, 2) OVER s / lead(px, 1) OVER s - 1 AS fwd FROM sg WINDOW s AS (PARTITION BY symbol ORDER BY bar_idx)), k AS (SELECT rank() OVER (ORDER BY round(signal, 9)) + (count(*) OVER (PARTITION BY round(signal, 9)) - 1) / 2.0 AS a, rank() OVER (ORDER BY round(fwd, 9)) + (count(*) OVER (PARTITION BY round(fwd, 9)) - 1) / 2.0 AS b FROM fw WHERE symbol = 'NO' AND signal IS NOT NULL AND fwd IS NOT NULL) SELECT count(*) AS n, {r('corr(a, b)', 'ic')} FROM k",
)
def ic_spearman(spark, sf):
    own = P.forward_returns(signalled(spark, sf), 1).where("symbol = 'NO'").withColumn("signal", half_away("signal", 9)).withColumn("fwd", half_away("fwd", 9))
    return rounded(inference.information_coefficient(own, "spearman").select("n", "ic"))


FW = f"WITH {DAILY}, {SIGS}, fw AS (SELECT *, lead(px, 2) OVER s / lead(px, 1) OVER s - 1 AS fwd FROM sg WINDOW s AS (PARTITION BY symbol ORDER BY bar_idx))"


def ic_by_series(pairs: DataFrame) -> DataFrame:
    return rounded(inference.products(pairs, ("series",)).groupBy(F.col("series").alias("symbol")).agg(F.count("x").alias("n"), F.avg("x").alias("ic")))


@query("ic_pearson_by_symbol", f"{FW} SELECT symbol, count(*) AS n, {r('corr(signal, fwd)', 'ic')} FROM fw WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY symbol")
def ic_pearson_by_symbol(spark, sf):
    return ic_by_series(P.forward_returns(signalled(spark, sf), 1).withColumn("series", F.col("symbol")))


@query(
    "ic_spearman_by_symbol",
    f"{FW}, k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY round(signal, 9)) + (count(*) OVER (PARTITION BY symbol, round(signal, 9)) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY round(fwd, 9)) + (count(*) OVER (PARTITION BY symbol, round(fwd, 9)) - 1) / 2.0 AS b FROM fw WHERE signal IS NOT NULL AND fwd IS NOT NULL) SELECT symbol, count(*) AS n, {r('corr(a, b)', 'ic')} FROM k GROUP BY symbol",
)
def ic_spearman_by_symbol(spark, sf):
    own = P.forward_returns(signalled(spark, sf), 1).where("signal IS NOT NULL AND fwd IS NOT NULL").withColumn("series", F.col("symbol"))
    for c in ("signal", "fwd"):
        own = inference.average_rank(own.withColumn(c, half_away(c, 9)), c, ("series",))
    return ic_by_series(own)


PV = "pv AS (SELECT symbol || month AS test, CASE WHEN symbol = 'RF' AND month = 3 THEN NULL ELSE round(1 / (1 + abs(m)), 6) END AS p_value FROM (SELECT symbol, month(ts) AS month, avg(ret) * 100 AS m FROM rets GROUP BY 1, 2))"


@query(
    "fdr",
    f"WITH {DAILY}, {PV}, k AS (SELECT *, count(p_value) OVER () AS m, row_number() OVER (PARTITION BY p_value IS NOT NULL ORDER BY p_value, test) AS rk FROM pv), s AS (SELECT *, min(p_value * m / rk) OVER (PARTITION BY p_value IS NOT NULL ORDER BY rk DESC) AS st FROM k), hm AS (SELECT sum(1.0 / i) AS hm FROM unnest(range(1, (SELECT max(m) + 1 FROM k))) AS u(i)) SELECT test, p_value, {r('CASE WHEN p_value IS NOT NULL THEN least(st, 1) END', 'p_value_bh')}, {r('CASE WHEN p_value IS NOT NULL THEN least(st * hm, 1) END', 'p_value_by')} FROM s, hm",
)
def fdr(spark, sf):
    tests = P.simple_returns(daily(spark, sf)).groupBy("symbol", F.month("ts").alias("month")).agg((F.avg("ret") * 100).alias("m"))
    p = F.when(~((F.col("symbol") == "RF") & (F.col("month") == 3)), F.round(1 / (1 + F.abs("m")), 6))
    return rounded(inference.adjust_p_values(tests.select(F.concat("symbol", F.col("month").cast("string")).alias("test"), p.alias("p_value"))))


@query(
    "breakeven",
    f"{IC}, ic AS (SELECT avg(x) AS ic FROM x), zz AS (SELECT avg(abs((signal - ms) / ss)) AS e FROM sg, (SELECT avg(signal) AS ms, stddev_pop(signal) AS ss FROM sg) WHERE signal IS NOT NULL), sr AS (SELECT stddev_pop(fwd) AS s FROM fd) SELECT {r('ic', 'ic')}, {r('e', 'e_abs_z')}, {r('s', 'sigma_r')}, {r('abs(ic) * s * 1e4', 'gross_bps', 3)}, {r('abs(ic) * s / (2 * e) * 1e4', 'c_star_bps', 3)} FROM ic, zz, sr",
)
def breakeven(spark, sf):
    own = inference.breakeven(cells(spark, sf))
    return rounded(own.select("ic", "e_abs_z", "sigma_r")).join(rounded(own.select("gross_bps", "c_star_bps"), 3))


@query("entry_lag", "WITH " + DAILY + ", " + SIGS + ", lags AS (SELECT unnest([1, 2, 5]) AS entry_lag), fw AS (" + " UNION ALL ".join(f"SELECT {k} AS entry_lag, ts, signal, lead(px, {k + 5}) OVER s / nullif(lead(px, {k}) OVER s, 0) - 1 AS fwd0 FROM sg WINDOW s AS (PARTITION BY symbol ORDER BY bar_idx)" for k in (1, 2, 5)) + ") , fd AS (SELECT *, fwd0 - avg(fwd0) OVER (PARTITION BY entry_lag, ts) AS fwd FROM fw) SELECT entry_lag, count(*) AS n, " + r("corr(signal, fwd)", "ic") + " FROM fd WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY 1")
def entry_lag(spark, sf):
    every = None
    for k in (1, 2, 5):
        own = cells(spark, sf, k).withColumn("entry_lag", F.lit(k))
        every = own if every is None else every.unionByName(own)
    keyed = inference.products(inference.demean(every, "fwd", ("entry_lag",)), ("entry_lag",))
    return rounded(keyed.groupBy("entry_lag").agg(F.count("x").alias("n"), F.avg("x").alias("ic")))


@query("entry_lag_all", "WITH " + DAILY + ", " + SIGS + ", fw AS (" + " UNION ALL ".join(f"SELECT {k} AS entry_lag, ts, signal, lead(px, {k + 5}) OVER s / nullif(lead(px, {k}) OVER s, 0) - 1 AS fwd0 FROM sg WINDOW s AS (PARTITION BY symbol ORDER BY bar_idx)" for k in (1, 2, 5, 10, 30)) + ") , fd AS (SELECT *, fwd0 - avg(fwd0) OVER (PARTITION BY entry_lag, ts) AS fwd FROM fw) SELECT entry_lag, count(*) AS n, " + r("corr(signal, fwd)", "ic") + " FROM fd WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY 1")
def entry_lag_all(spark, sf):
    every = None
    for k in (1, 2, 5, 10, 30):
        own = cells(spark, sf, k).withColumn("entry_lag", F.lit(k))
        every = own if every is None else every.unionByName(own)
    keyed = inference.products(inference.demean(every, "fwd", ("entry_lag",)), ("entry_lag",))
    return rounded(keyed.groupBy("entry_lag").agg(F.count("x").alias("n"), F.avg("x").alias("ic")))


@query("split_parts", f"{IC}, bb AS (SELECT max(bar_idx) + 1 AS bars FROM panel), pt AS (SELECT fd.*, CAST(((bar_idx + 1) * 4 - 1) // bars AS INTEGER) AS part FROM fd, bb) SELECT part, count(*) AS n, {r('corr(signal, fwd)', 'ic')} FROM pt WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY 1")
def split_parts(spark, sf):
    x = inference.products(inference.parts(inference.demean(cells(spark, sf)), 4), ("part",))
    return rounded(x.groupBy("part").agg(F.count("x").alias("n"), F.avg("x").alias("ic")))


@query(
    "data_quality",
    f"WITH {HOURLY}, s AS (SELECT session, count(DISTINCT ts) AS c FROM hraw GROUP BY 1) SELECT (SELECT count(*) FROM s) AS sessions, (SELECT {r('avg(c)', 'x').replace(' AS x', '')} FROM s) AS bars_per_session, (SELECT count(*) FROM s WHERE c = 24) AS complete_sessions, {r('avg(CASE WHEN px0 IS NULL THEN 1.0 ELSE 0.0 END)', 'missing')}, count(DISTINCT symbol) AS symbols FROM hraw",
)
def data_quality(spark, sf):
    raw = P.densify(hourly_bars(spark, sf).select("ts", "symbol", F.col("close").alias("px"))).withColumn("session", P.session_id(F.col("ts")))
    return rounded(inference.data_quality(raw, 24))


# --- universe, store, validation --------------------------------------------


@query(
    "universe_rank",
    "WITH d AS (SELECT p_brand AS symbol, l_shipdate AS ts, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), s AS (SELECT symbol, median(close * volume) AS v, median(close) AS c, count(*) AS n FROM d GROUP BY 1) "
    f"SELECT symbol, {r('v', 'median_dollar_volume', 4)}, {r('c', 'median_close')}, n AS n_days FROM s WHERE n >= greatest(floor((SELECT max(n) FROM s) * 0.8), 1) AND v >= 1000 ORDER BY v DESC, symbol LIMIT 10",
)
def universe_rank(spark, sf):
    lines, parts = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "part"))
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    own = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("symbol"), "l_shipdate").agg((money("l_extendedprice") / money("l_quantity")).alias("close"), money("l_quantity").alias("volume"))
    ranked = store.rank_universe(own, 10, 1000.0)
    return ranked.select("symbol", half_away("median_dollar_volume", 4).alias("median_dollar_volume"), half_away("median_close", 6).alias("median_close"), "n_days")


@query("candidate_symbols", "SELECT DISTINCT regexp_replace(upper(p_type), '[^A-Z]', '', 'g') AS symbol FROM part WHERE p_size % 3 <> 0 AND NOT (contains(lower(' ' || p_name || ' '), ' fund') OR contains(lower(' ' || p_name || ' '), 'inverse')) AND regexp_replace(upper(p_type), '[^A-Z]', '', 'g') <> ''")
def candidate_symbols(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    assets = parts.select(F.regexp_replace(F.upper("p_type"), "[^A-Z]", "").alias("symbol"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 != 0, "active").otherwise("inactive").alias("status"), F.lit(True).alias("tradable"), F.lit("X").alias("exchange"))
    return store.candidate_symbols(assets)


@query("store_summary", "SELECT event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN 'sip' ELSE 'iex' END AS feed, count(*) AS bars, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts FROM events GROUP BY 1, 2")
def store_summary(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    bars = events.select(F.col("event_type").alias("symbol"), F.when(F.col("user_id") % 2 == 0, "sip").otherwise("iex").alias("feed"), F.col("ts").alias("timestamp"))
    return rounded(store.store_summary(bars))


@query(
    "purged_kfold",
    f"WITH {DAILY}, s AS (SELECT DISTINCT bar_idx AS idx FROM panel), n AS (SELECT count(*) AS n FROM s), f AS (SELECT k AS fold, n * k // 5 AS lo, n * (k + 1) // 5 AS hi FROM n, unnest(range(0, 5)) AS u(k)), x AS (SELECT fold, CASE WHEN idx >= lo AND idx < hi THEN 'test' WHEN idx < lo - 2 OR idx >= hi + 5 THEN 'train' END AS role, idx FROM s, f) SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n, CAST(min(idx) AS BIGINT) AS first, CAST(max(idx) AS BIGINT) AS last FROM x WHERE role IS NOT NULL GROUP BY 1, 2",
)
def purged_kfold(spark, sf):
    samples = daily(spark, sf).select(F.col("bar_idx").alias("idx")).distinct()
    return validate.purged_kfold(samples, samples.count(), 5, 5, 3).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


GRID = (10, 20, 40)
WF = "WITH " + DAILY + ", " + ", ".join(f"lz{i} AS (SELECT ts, bar_idx, symbol, ret, {i} AS point, CASE WHEN count(ln(px)) OVER w = {n} THEN (ln(px) - avg(ln(px)) OVER w) / stddev_samp(ln(px)) OVER w END AS z FROM rets WINDOW {frame(n - 1)})" for i, n in enumerate(GRID)) + """,
every AS (""" + " UNION ALL ".join(f"SELECT ts, bar_idx, symbol, ret, point, {clip_sql('-z / 2.0')} AS signal FROM lz{i}" for i in range(len(GRID))) + """),
nb AS (SELECT max(bar_idx) + 1 AS n FROM panel),
folds AS (SELECT k AS fold, s, s + 504 AS t, s + 630 AS e FROM (SELECT k, k * 126 AS s FROM nb, unnest(range(0, 200)) AS u(k)), nb WHERE s + 630 <= n),
blocks AS (SELECT fold, 'train' AS kind, s AS lo, t AS hi, greatest(0, s - 40) AS f FROM folds UNION ALL SELECT fold, 'test', t, e, greatest(0, t - 40) FROM folds),
rows_ AS (SELECT every.*, fold, kind, lo, f FROM every JOIN blocks ON bar_idx >= f AND bar_idx < hi),
hh AS (SELECT *, lag(signal) OVER s AS held, px_ret AS r2 FROM (SELECT *, CASE WHEN bar_idx > f THEN ret END AS px_ret FROM rows_) WINDOW s AS (PARTITION BY fold, point, kind, symbol ORDER BY bar_idx)),
cc AS (SELECT *, held * r2 AS gross, abs(held - lag(held) OVER (PARTITION BY fold, point, kind, symbol ORDER BY bar_idx)) * 2.0 / 1e4 AS cost FROM hh),
bk AS (SELECT fold, point, kind, bar_idx, sum(gross) - coalesce(sum(cost), 0) AS net FROM cc WHERE bar_idx >= greatest(lo, f + 40) GROUP BY 1, 2, 3, 4),
sc AS (SELECT fold, point, avg(net) FILTER (WHERE kind = 'train') / stddev_samp(net) FILTER (WHERE kind = 'train') * sqrt(252.0) AS tr, avg(net) FILTER (WHERE kind = 'test') / stddev_samp(net) FILTER (WHERE kind = 'test') * sqrt(252.0) AS te, sum(net) FILTER (WHERE kind = 'test') AS ret FROM bk GROUP BY 1, 2),
wf AS (SELECT CAST(fold AS INTEGER) AS fold, point, tr, te, ret, row_number() OVER (PARTITION BY fold ORDER BY tr DESC, point) = 1 AS selected FROM sc)"""


def walked(spark, sf) -> DataFrame:
    return validate.walk_forward(daily(spark, sf), SIGNALS["zscore_reversion"], validate.grid(window=list(GRID)), 504, 126, None, 40)


@query("walk_forward", WF + f" SELECT fold, point, {r('tr', 'train_sharpe', 4)}, {r('te', 'test_sharpe', 4)}, {r('ret', 'test_return', 4)}, selected FROM wf")
def walk_forward(spark, sf):
    return rounded(walked(spark, sf), 4)


@query("parameter_stability", WF + f", p AS (SELECT point, count(*) / sum(count(*)) OVER () AS p FROM wf WHERE selected GROUP BY 1), s AS (SELECT -sum(p * ln(p)) / ln(3) AS entropy, max(p) AS modal_share, count(*) AS n_distinct FROM p) SELECT {r('entropy', 'entropy')}, {r('modal_share', 'modal_share')}, n_distinct, CASE WHEN entropy < 0.3 THEN 'stable' WHEN entropy < 0.7 THEN 'mixed' ELSE 'unstable' END AS verdict FROM s")
def parameter_stability(spark, sf):
    return rounded(validate.parameter_stability(walked(spark, sf), len(GRID)))


@query("walk_forward_book", WF + f" SELECT bk.fold::INTEGER AS fold, bk.point, bar_idx, {r('net', 'net')} FROM bk JOIN wf ON bk.fold = wf.fold AND bk.point = wf.point WHERE selected AND kind = 'test'")
def walk_forward_book(spark, sf):
    book = validate.walk_forward_book(daily(spark, sf), SIGNALS["zscore_reversion"], validate.grid(window=list(GRID)), 504, 126, None, 40)
    return rounded(book.select("fold", "point", "bar_idx", "net"))


# --- luck: the twins take the normal law from its series and quantiles by bisection ---


def cdf_sql(x: str) -> str:
    """The standard normal distribution function within 8 deviations, beyond which it is 0 or 1 to 15 digits."""
    near = f"least(greatest({x}, -8.0), 8.0)"
    term = "exp((2 * k + 1) * ln(greatest(abs(y), 1e-300)) - y * y / 2 - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2)"
    return f"(SELECT 0.5 + sign(y) * sum({term}) / sqrt(2 * pi()) FROM (SELECT {near} AS y, unnest(range(0, 120)) AS k) GROUP BY y)"


def luck_sql(*n_trials: int) -> str:
    """luck: the mean greatest of n standard normal numbers, as metrics.expected_max_sharpe has it, by n."""
    rows = ", ".join(f"({n}, {w}, {p})" for n in n_trials for w, p in ((f"1 - {metrics.EULER}", f"1 - 1 / {n}::DOUBLE"), (metrics.EULER, f"1 - 1 / ({n} * exp(1))")))
    return f"""bisect AS (SELECT n, w::DOUBLE AS w, p::DOUBLE AS p, -8.0::DOUBLE AS lo, 8.0::DOUBLE AS hi, 0 AS step FROM (VALUES {rows}) AS v(n, w, p) UNION ALL
SELECT n, w, p, CASE WHEN c < p THEN mid ELSE lo END, CASE WHEN c < p THEN hi ELSE mid END, step + 1 FROM (SELECT *, {cdf_sql('mid')} AS c FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisect WHERE step < 50))),
luck AS (SELECT n, sum(w * (lo + hi) / 2) AS z FROM bisect WHERE step = 50 GROUP BY 1)"""


PSR = f"{BOOK}, {EQ}, {SUMMARY}".split("\nSELECT n_periods")[0].replace("WITH ", "WITH RECURSIVE ", 1) + f""", {luck_sql(21)},
x AS (SELECT sharpe_per_period AS sr, n_returns AS n, z / sqrt(n_returns - 1) AS top, sqrt((n_returns - 1) / (1 - skew * sharpe_per_period + (kurtosis - 1) / 4 * pow(sharpe_per_period, 2))) AS scale FROM s, luck),
y AS (SELECT top, sr * scale AS a, (sr - top) * scale AS b FROM x)
SELECT {r(cdf_sql('a'), 'psr')}, {r(cdf_sql('b'), 'dsr')}, {r('top', 'expected_max')} FROM y"""
COST = f"""WITH RECURSIVE {luck_sql(5, 20)}, t AS (SELECT max(z) FILTER (WHERE n = 5) * sqrt(252 / 2499.0) AS one, max(z) FILTER (WHERE n = 20) * sqrt(252 / 2499.0) AS many FROM luck)
SELECT {r('one', 'threshold_unconditional')}, {r('many', 'threshold_conditional')}, {r('many / one', 'multiplier')}, {r('sqrt(252 / 625.0::DOUBLE)', 'sharpe_se_per_regime')} FROM t"""


@query("probabilistic_sharpe", PSR)
def probabilistic_sharpe(spark, sf):
    s = metrics.summary(scaled(spark, sf)).first()
    own = (s.sharpe_per_period, s.n_returns, s.skew, s.kurtosis)
    rows = [(metrics.probabilistic_sharpe(*own), metrics.deflated_sharpe(*own, 21), metrics.expected_max_sharpe(21, 1 / (s.n_returns - 1)))]
    return rounded(spark.createDataFrame(rows, "psr double, dsr double, expected_max double"))


@query("hypothesis_cost", COST)
def hypothesis_cost(spark, sf):
    return rounded(spark.createDataFrame([regime.hypothesis_cost(5, 4, 2500)]))


# --- generators: keyed draws, so the twins draw the same numbers ------------


def unit_sql(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def normal_sql(key: str) -> str:
    return f"(sqrt(-2 * ln({unit_sql(key + " || '|u'")})) * cos(2 * pi() * {unit_sql(key + " || '|v'")}))"


CELL = "seed || '|' || bar_idx || '|' || asset"
CHI = " + ".join(f"pow({normal_sql(f"{CELL} || '|chi|{k}'")}, 2)" for k in range(1, 6))
SHOCKS = f"""WITH RECURSIVE days AS (SELECT row_number() OVER (ORDER BY d) - 1 AS bar_idx, CAST(d AS VARCHAR) AS ts FROM (SELECT unnest(range(TIMESTAMP '2015-01-01', TIMESTAMP '2018-01-01', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6),
cell AS (SELECT seed, bar_idx, asset FROM (SELECT unnest([1::BIGINT, 2::BIGINT]) AS seed), (SELECT unnest(range(0, 300)) AS bar_idx), (SELECT unnest([0, 1, 2]) AS asset)),
zs AS MATERIALIZED (SELECT *, sqrt(0.2) * {normal_sql("seed || '|' || bar_idx || '|common'")} + sqrt(0.8) * {normal_sql(CELL)} AS z, {CHI} AS chi, {unit_sql("seed || '|' || bar_idx || '|state'")} AS switch, {unit_sql(CELL + " || '|direction'")} AS direction FROM cell)"""
PRICED = "SELECT seed, lp.bar_idx, 'asset_' || asset AS symbol, ts, " + r("exp(ln(100) + x)", "px") + " FROM lp JOIN days ON days.bar_idx = lp.bar_idx"
NEXT = "JOIN zs ON zs.seed = lp.seed AND zs.asset = lp.asset AND zs.bar_idx = lp.bar_idx + 1"
DT, THETA, PULL = "(1 / 252.0::DOUBLE)", "(ln(2) / 10)", "(1 - exp(-ln(2) / 5))"
TWINS = {
    "gbm": f"{SHOCKS}, lp AS (SELECT *, sum(CASE WHEN bar_idx = 0 THEN 0 ELSE -0.02 * {DT} + 0.2 * sqrt({DT}) * z END) OVER (PARTITION BY seed, asset ORDER BY bar_idx) AS x FROM zs) {PRICED}",
    "ornstein_uhlenbeck": f"{SHOCKS}, lp AS (SELECT seed, asset, bar_idx, 0.0::DOUBLE AS x FROM zs WHERE bar_idx = 0 UNION ALL SELECT zs.seed, zs.asset, zs.bar_idx, exp(-{THETA}) * x + sqrt(0.04 * {DT} / (2 * {THETA}) * (1 - exp(-2 * {THETA}))) * z FROM lp {NEXT}) {PRICED}",
    "garch_t": f"{SHOCKS}, lp AS (SELECT seed, asset, bar_idx, 0.0::DOUBLE AS x, 0.04 * {DT} AS v FROM zs WHERE bar_idx = 0 UNION ALL "
    f"SELECT seed, asset, bar_idx, x - v / 2 + e, 0.04 * {DT} * (1 - 0.08 - 0.9) + 0.08 * e * e + 0.9 * v FROM (SELECT zs.seed, zs.asset, zs.bar_idx, x, v, sqrt(v) * z / sqrt(chi / 5) * sqrt(0.6) AS e FROM lp {NEXT})) {PRICED}",
    "regime_switching": f"{SHOCKS}, lp AS (SELECT seed, asset, bar_idx, 0.0::DOUBLE AS x, 0.0::DOUBLE AS anchor, switch < 0.5 AS trend, CASE WHEN direction < 0.5 THEN 1 ELSE -1 END AS side FROM zs WHERE bar_idx = 0 UNION ALL "
    f"SELECT seed, asset, bar_idx, x + 0.2 * sqrt({DT}) * z + CASE WHEN trend THEN side * 0.6 * {DT} ELSE {PULL} * (anchor - x) END, anchor, trend, side FROM ("
    "SELECT zs.seed, zs.asset, zs.bar_idx, z, x, CASE WHEN switch > 0.97 THEN x ELSE anchor END AS anchor, CASE WHEN switch > 0.97 THEN NOT trend ELSE trend END AS trend, "
    f"CASE WHEN switch <= 0.97 THEN side WHEN direction < 0.5 THEN 1 ELSE -1 END AS side FROM lp {NEXT})) {PRICED}",
}


def generator_query(name: str):
    @query(f"simulate_{name}", TWINS[name])
    def run(spark, sf):
        from tidemark.plans.api import GENERATORS

        return rounded(GENERATORS[name](spark, 300, 3, [1, 2], correlation=0.2))


for _name in TWINS:
    generator_query(_name)


# --- without a twin ---------------------------------------------------------


@query("portfolio_ledger")
def portfolio_ledger(spark, sf):
    from tidemark.plans.portfolio import run_portfolio

    panel = daily(spark, sf).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "bar_idx", "px").persist()
    return rounded(run_portfolio(panel, tier=2).ledger())


REGISTRY = {
    "budget": 30,
    "hypotheses": [
        {"id": f"T{i}", "signal": s, "params": p, "horizons_bars": [5, 20], "universe": "daily", "prediction": "IC > 0", "mechanism": "-", "status": "registered"}
        for i, (s, p) in enumerate([("zscore_reversion", {"window": 20}), ("timeseries_momentum", {"window": 60}), ("vol_breakout", {"window": 20}), ("always_long", {})])
    ],
}


@query("ic_grid")
def ic_grid(spark, sf):
    from tidemark.plans.ic_grid import run_grid

    grid = run_grid(spark, daily(spark, sf).persist(), REGISTRY, session_length=None)
    return rounded(grid.select("hypothesis_id", "signal", "horizon", "ic", "ic_raw", "ic_entry_lag0", "t_hac", "p_value", "p_value_bh", "p_value_by"))


@query("streaming_bars", ORACLE_SQL["bars_ohlcv"])
def streaming_bars(spark, sf):
    """The bars of a stream over the events' files, as its last batch leaves them."""
    from tidemark.streaming.bars import bars_of_stream, windowed_bars

    path = f"{sf}/events.parquet"
    # a stream reads folders or patterns; the table may be one file
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/[e]vents.parquet")
    return rounded(bars_of_stream(windowed_bars(events.withColumn("ts", F.col("ts").cast("timestamp")))))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: daily panel, reversion signal, net book by day."""
    return rounded(book(spark, sf))
