"""The bar store: Parquet, partitioned by date and symbol, append only."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.panel import densify, forward_fill, forward_returns, purged_forward_returns, session_id

#: The fixed columns of a bar; further columns (signal_<name>, position, traded) may follow.
CORE = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("symbol", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
        T.StructField("trade_count", T.DoubleType()),
        T.StructField("vwap", T.DoubleType()),
        T.StructField("feed", T.StringType()),
    ]
)


def dated(bars: DataFrame, ts: str) -> DataFrame:
    """bars with the date of their session, by which the store is partitioned."""
    return bars.withColumn("date", F.date_format(session_id(F.col(ts)), "yyyy-MM-dd"))


class BarStore:
    """Bars at a path that Spark can write; every write adds files and never replaces any."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, bars: DataFrame) -> None:
        if missing := {f.name for f in CORE} - set(bars.columns):
            raise ValueError(f"bars lack {sorted(missing)}")
        own = bars.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in CORE})
        if "signals" in own.columns:  # a map of signals becomes columns
            names = sorted(r[0] for r in own.select(F.explode(F.map_keys("signals"))).distinct().collect())
            own = own.withColumns({f"signal_{n}": F.try_element_at("signals", F.lit(n)) for n in names}).drop("signals")
        dated(own, "timestamp").repartition("date", "symbol").write.mode("append").partitionBy("date", "symbol").parquet(self.path)

    def load(self, start: str | None = None, end: str | None = None, symbols: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """Bars of the dates (inclusive) and symbols: partitions are pruned, columns are pushed to the scan."""
        bars = self.spark.read.option("mergeSchema", "true").parquet(self.path).withColumn("date", F.col("date").cast("string"))
        if start:
            bars = bars.where(F.col("date") >= start)
        if end:
            bars = bars.where(F.col("date") <= end)
        if symbols is not None:
            bars = bars.where(F.col("symbol").isin(symbols))
        return bars.select(*columns) if columns else bars

    def summary(self) -> DataFrame:
        return store_summary(self.load())

    def forward_returns(self, horizon: int, embargo: int | None = None, field: str = "close", entry_lag: int = 1, within_session: bool = True, **which) -> DataFrame:
        cells = self.load(columns=["timestamp", "symbol", field], **which).groupBy(F.col("timestamp").alias("ts"), "symbol").agg(F.max(field).alias("px"))  # of bars that were stored twice, the greatest value
        panel = densify(cells).withColumn("session", session_id(F.col("ts")))
        return purged_forward_returns(panel, horizon, embargo, entry_lag, "session" if within_session else None)


def store_summary(bars: DataFrame, ts: str = "timestamp") -> DataFrame:
    return bars.groupBy("symbol", "feed").agg(F.count(F.lit(1)).alias("bars"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def session_filled_panel(bars: DataFrame, field: str = "close", ts: str = "ts") -> DataFrame:
    """The dense panel of a field, forward filled inside sessions only."""
    cells = bars.groupBy(ts, "symbol").agg(F.max(field).alias("px"))  # bars may repeat; the panel has one cell for each
    panel = densify(cells).withColumn("session", session_id(F.col(ts)))
    return forward_fill(panel, "px", "session")


def backfill_plan(spark: SparkSession, start: date, end: date, symbols: list[str], group: int = 20, done: DataFrame | None = None) -> DataFrame:
    """window_start, window_end and symbols of the monthly work items that the manifest lacks."""
    windows, at = [], start.replace(day=1)
    while at <= end:
        after = (at.replace(day=28) + timedelta(days=4)).replace(day=1)
        windows.append((max(at, start), min(after - timedelta(days=1), end)))
        at = after
    groups = [symbols[i : i + group] for i in range(0, len(symbols), group)]
    plan = spark.createDataFrame([(a, b, k, g) for a, b in windows for k, g in enumerate(groups)], "window_start date, window_end date, part int, symbols array<string>")
    return plan if done is None else plan.join(done.select("window_start", "part"), ["window_start", "part"], "left_anti")


def as_utc(value: datetime | date | str) -> datetime:
    value = datetime.fromisoformat(value) if isinstance(value, str) else value
    value = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def chunks(items: list, size: int) -> Iterable[list]:
    return (items[i : i + size] for i in range(0, len(items), size))


def check_feed(feed: str, end: datetime, now: datetime, allow_iex: bool = False) -> None:
    """Refuse what a feed can't give: the consolidated feed (sip) is 15 minutes late, iex must be allowed."""
    if feed == "sip" and as_utc(end) > as_utc(now) - timedelta(minutes=15):
        raise ValueError("the sip feed ends 15 minutes ago")
    if feed == "iex" and not allow_iex:
        raise ValueError("iex is a part of the market: allow it explicitly")
    if feed not in ("sip", "iex"):
        raise ValueError(f"unknown feed {feed}")


def retry(call, attempts: int = 5, base: float = 0.5, sleep=None, draw=None):
    """call(), again after growing random pauses if it fails."""
    import random
    import time

    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            (sleep or time.sleep)(base * 2**k * (1 + (draw or random.random)()))


def bar_source(fetch, name: str = "bars"):
    """A batch data source whose partitions are chunks of symbols; fetch(symbols, start, end) yields bar tuples in the order of CORE."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Chunk(InputPartition):
        def __init__(self, symbols: list[str]):
            self.symbols = symbols

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            symbols = [s for s in self.options.get("symbols", "").split(",") if s]
            return [Chunk(c) for c in chunks(symbols, int(self.options.get("chunk", 100)))]

        def read(self, partition):
            yield from retry(lambda: list(fetch(partition.symbols, self.options.get("start"), self.options.get("end"))))

    class Bars(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return CORE

        def reader(self, schema):
            return Reader(self.options)

    return Bars


#: Parts of the names of pooled vehicles, looked for in " name " in lower case.
FUND_WORDS = (
    "proshares", "direxion", "invesco", "ishares", "vanguard", "spdr", "state street", "global x", "vaneck", "first trust",
    "wisdomtree", "schwab strategic", "grayscale", "bitwise", "xtrackers", "amplify", "roundhill", "yieldmax", "defiance",
    "graniteshares", "simplify", "innovator", "pacer", "ark ", "janus henderson", "goldman sachs etf", "jpmorgan etf",
    "fidelity covington", "franklin", "tidal", "rex shares", "t-rex", "volatility shares",
    " etf", "etf ", "exchange traded", " etn", "index fund", "index trust", "select sector", "unit trust", " trust,", "trust shares", " fund",
    "ultrapro", "ultrashort", "ultra ", "bull 3x", "bear 3x", "bull 2x", "bear 2x", "1.5x", " 2x ", " 3x ", "-1x", "inverse", "leveraged",
    "daily ", "short qqq", "long qqq",
)


def is_fund(name: Column) -> Column:
    """True for names of pooled vehicles; null names are none."""
    import re

    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    return F.coalesce(padded.rlike("|".join(re.escape(w) for w in FUND_WORDS)), F.lit(False)) & (F.coalesce(F.length(name), F.lit(0)) > 0)


def candidate_symbols(assets: DataFrame) -> DataFrame:
    """Active, tradable, listed, alphabetic symbols that aren't funds, in order. assets: symbol, name, status, tradable, exchange."""
    own = assets.where((F.col("status") == "active") & F.col("tradable") & (F.col("exchange") != "OTC") & F.col("symbol").rlike("^[A-Za-z]+$") & ~is_fund(F.col("name")))
    return own.select("symbol").distinct().orderBy("symbol")


def rank_universe(daily: DataFrame, n: int = 50, min_dollar_volume: float = 5e7, min_days: float = 0.8) -> DataFrame:
    """The n symbols with the highest median dollar volume, of those with a nearly complete history. daily: symbol, close, volume."""
    stats = daily.groupBy("symbol").agg(
        F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).alias("median_dollar_volume"), F.percentile("close", F.lit(0.5)).alias("median_close"), F.count(F.lit(1)).alias("n_days")
    )
    longest = stats.agg(F.greatest(F.floor(F.max("n_days") * min_days), F.lit(1)).alias("_need"))
    own = stats.join(F.broadcast(longest)).where((F.col("n_days") >= F.col("_need")) & (F.col("median_dollar_volume") >= min_dollar_volume))  # one row
    return own.drop("_need").orderBy(F.col("median_dollar_volume").desc(), "symbol").limit(n)


def calendar(spark: SparkSession, start: str, end: str, holidays: tuple[str, ...] = (), half_days: tuple[str, ...] = ()) -> DataFrame:
    """session, open and close (UTC) and minutes of the exchange's days."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("session")).where(F.weekday("session") < 5)
    text = F.date_format("session", "yyyy-MM-dd")
    days = days.where(~text.isin(list(holidays))) if holidays else days
    half = text.isin(list(half_days)) if half_days else F.lit(False)
    at = lambda t: F.to_utc_timestamp(F.to_timestamp(F.concat(text, F.lit(" "), t)), "America/New_York")
    out = days.select("session", at(F.lit("09:30:00")).alias("open"), at(F.when(half, "13:00:00").otherwise("16:00:00")).alias("close"))
    return out.withColumn("minutes", F.expr("cast((unix_timestamp(close) - unix_timestamp(open)) / 60 as int)"))


def clock(calendar_: DataFrame, now: datetime) -> DataFrame:
    """Whether the market is open at `now`, and the next open and close."""
    t = F.lit(now)
    return calendar_.agg(F.coalesce(F.bool_or((F.col("open") <= t) & (t < F.col("close"))), F.lit(False)).alias("is_open"), F.min(F.when(F.col("open") > t, F.col("open"))).alias("next_open"), F.min(F.when(F.col("close") > t, F.col("close"))).alias("next_close"))


__all__ = ["BarStore", "CORE", "backfill_plan", "bar_source", "calendar", "candidate_symbols", "check_feed", "clock", "forward_returns", "is_fund", "rank_universe", "retry", "session_filled_panel", "store_summary"]
