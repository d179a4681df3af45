"""Price panels in long form: symbol, ts, bar_idx, px.

All shifts count panel rows, so a panel is first put on the full grid of its
timestamps and symbols (`densify`); missing cells are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio, safe_ln

#: Symbols are the panel's columns: more are a sign of a wrong key.
MAX_SYMBOLS = 100_000
NEW_YORK = "America/New_York"


def by_symbol(*first: str) -> Window:
    return Window.partitionBy(*first, "symbol").orderBy("bar_idx")


def trailing(n: int, last: int = 0, *first: str):
    """The last n rows up to `last` (0: this row, -1: the row before) of the symbol."""
    return by_symbol(*first).rowsBetween(last - n + 1, last)


def full(value: Column, x: Column | str, window, n: int) -> Column:
    """value, if the frame holds n defined x."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(window) == n, value)


def densify(cells: DataFrame, ts: str = "ts") -> DataFrame:
    """Every timestamp with every symbol, bar_idx counting timestamps from 0; cells that are missing have nulls."""
    symbols = [r[0] for r in cells.select("symbol").where("symbol IS NOT NULL").distinct().limit(MAX_SYMBOLS + 1).collect()]
    if len(symbols) > MAX_SYMBOLS:
        raise ValueError(f"more than {MAX_SYMBOLS} symbols")
    # timestamps are one short column even for a very large panel
    stamps = cells.select(ts).where(F.col(ts).isNotNull()).distinct().select(ts, (F.row_number().over(Window.orderBy(ts)) - 1).cast("long").alias("bar_idx"))
    grid = stamps.select(ts, "bar_idx", F.explode(F.array(*[F.lit(s) for s in sorted(symbols)]) if symbols else F.array().cast("array<string>")).alias("symbol"))
    return grid.join(cells, [ts, "symbol"], "left")


def forward_fill(df: DataFrame, column: str = "px", within: str | None = None) -> DataFrame:
    """The last defined value so far, of the symbol or of the symbol's session."""
    w = by_symbol(*([within] if within else [])).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def session_id(ts: Column | str) -> Column:
    """The New York date of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, NEW_YORK))


def regular_hours(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows within 09:30 (in) and 16:00 (out) New York time."""
    local = F.from_utc_timestamp(F.col(ts), NEW_YORK)
    minute = F.hour(local) * 60 + F.minute(local)
    return df.where((minute >= 570) & (minute < 960))


def simple_returns(df: DataFrame, name: str = "ret") -> DataFrame:
    return df.withColumn(name, ratio("px", F.lag("px").over(by_symbol())) - 1)


def log_returns(df: DataFrame, name: str = "lret") -> DataFrame:
    return df.withColumn(name, safe_ln("px") - F.lag(safe_ln("px")).over(by_symbol()))


def to_panel(bars: DataFrame, field: str = "close") -> DataFrame:
    """The last value of a field for each timestamp and symbol, on the full grid."""
    order = F.struct(*[c for c in ("ts", "seq") if c in bars.columns])
    return densify(bars.groupBy("ts", "symbol").agg(F.max_by(field, order).alias("px")))


def bars(events: DataFrame, bucket: str, ts: str, symbol: str, value: str, seq: str) -> DataFrame:
    """Open, high, low, close, volume (rows) and trade_count of each bucket and symbol; ties of ts are ordered by seq."""
    at = F.struct(ts, seq)
    return events.groupBy(F.date_trunc(bucket, F.col(ts)).alias("ts"), F.col(symbol).alias("symbol")).agg(
        F.min_by(value, at).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, at).alias("close"),
        F.count(value).alias("volume"),
    )


def wide(df: DataFrame, column: str = "px", symbols: list[str] | None = None) -> DataFrame:
    """One column for each symbol, for display."""
    return df.groupBy("ts").pivot("symbol", symbols).agg(F.max(column))


def unpivot(df: DataFrame, columns: list[str], value: str = "px") -> DataFrame:
    """The inverse of `wide`, without nulls."""
    return df.unpivot(["ts"], columns, "symbol", value).where(F.col(value).isNotNull())


def forward_returns(df: DataFrame, horizon: int, entry_lag: int = 1, session: str | None = None) -> DataFrame:
    """fwd: px[t + lag + horizon] / px[t + lag] - 1; null where that leaves the session of t."""
    w = by_symbol()
    fwd = ratio(F.lead("px", entry_lag + horizon).over(w), F.lead("px", entry_lag).over(w)) - 1
    if session:
        fwd = F.when(F.lead(session, entry_lag + horizon).over(w) == F.col(session), fwd)
    return df.withColumn("fwd", fwd)


def purged_forward_returns(df: DataFrame, horizon: int, embargo: int | None = None, entry_lag: int = 1, session: str | None = None) -> DataFrame:
    """Defined forward returns, each with the timestamp up to which it must be kept out of training."""
    embargo = horizon if embargo is None else embargo
    line = df.select("bar_idx", F.col("ts").alias("embargo_until")).distinct()
    last = df.agg(F.max("bar_idx").alias("last_idx"))
    own = forward_returns(df, horizon, entry_lag, session).where("fwd IS NOT NULL").join(F.broadcast(last))  # one row
    at = F.least(F.col("bar_idx") + horizon + embargo, F.col("last_idx")).alias("until_idx")
    return own.select("symbol", "ts", "bar_idx", "fwd", at).join(line.withColumnRenamed("bar_idx", "until_idx"), "until_idx").drop("until_idx")


def downsample(df: DataFrame, max_points: int, order: str = "ts") -> DataFrame:
    """Every k-th row and the last, k = max(1, rows div max_points); df is one series."""
    w = Window.orderBy(order)
    n = df.count()
    step = max(1, n // max_points)
    return df.withColumn("_k", F.row_number().over(w) - 1).where((F.col("_k") % step == 0) | (F.col("_k") == n - 1)).drop("_k")
