"""OHLCV panels keyed by (ticker, session).

Ticks become bars by one aggregation that combines on the map side; from then
on a panel is as small as its sessions and every window shuffles by ticker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(ticks: DataFrame, ticker: Column, session: Column, price: Column, size: Column, order: Column) -> DataFrame:
    """First, highest, lowest and last price and the summed size of each (ticker, session)."""
    tick = ticks.select(ticker.alias("ticker"), session.alias("session"), price.alias("price"), size.cast("double").alias("size"), order.alias("order"))
    return (
        tick.groupBy("ticker", "session")
        .agg(F.min_by("price", "order").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "order").alias("close"), F.sum("size").alias("volume"))
    )


def daily(spark: SparkSession, sf_dir: str, ticker: str = "l_linestatus") -> DataFrame:
    """Daily bars of lineitem, by line status (two members) or any other column of it."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    price = F.lit(100.0) + F.col("l_extendedprice") / 10000.0
    return bars(table(spark, sf_dir, "lineitem"), F.col(ticker).cast("string"), F.to_date("l_shipdate"), price, F.col("l_quantity"), order)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events by event type."""
    price = F.lit(100.0) + F.col("value") / 50.0
    return bars(table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", F.col("ts").cast("timestamp")), price, F.lit(1.0), F.col("event_id"))


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders by priority."""
    price = F.lit(100.0) + F.col("o_totalprice") / 50000.0
    return bars(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.to_date("o_orderdate"), price, F.lit(1.0), F.col("o_orderkey"))


def flatten_columns(names: list[tuple[str, ...] | str], ticker: str) -> list[str]:
    """One name for each column of a two-level header, whichever level holds the ticker."""
    out = []
    for name in names:
        parts = [name] if isinstance(name, str) else [p for p in name if p and p != ticker]
        if len(parts) != 1:
            raise ValueError(f"cannot name column {name!r}")
        out.append(parts[0])
    if len(set(out)) != len(out):
        raise ValueError("two columns flatten to one name")
    return out


def normalize(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """A raw bar table as a panel.

    Column names in any case; the session is cut to its date as written (a time
    zone is dropped, not converted); prices that are no numbers become null;
    rows without a close go.
    """
    found = {c.lower(): c for c in raw.columns}
    session = next((found[n] for n in ("session", "date", "datetime", "timestamp") if n in found), None)
    missing = [c for c in BAR_COLUMNS if c not in found]
    if session is None or missing:
        raise ValueError(f"missing columns: {(['session'] if session is None else []) + missing}")
    name = F.col(found["ticker"]).cast("string") if "ticker" in found else F.lit(ticker)
    day = F.to_date(F.substring(F.col(session).cast("string"), 1, 10))
    columns = [F.col(found[c]).cast("string").try_cast("double").alias(c) for c in BAR_COLUMNS]
    return raw.select(name.alias("ticker"), day.alias("session"), *columns).where(F.col("close").isNotNull() & ~F.isnan("close"))


#: Panels of a folder of tables by the name that a configuration gives them.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"bars_daily": daily, "bars_hourly": hourly, "order_flow": order_flow}
VENDORS: dict[str, Vendor] = {}


def register(vendor: Vendor) -> None:
    """Make a vendor's bars available to configurations under its name."""
    VENDORS[vendor.name] = vendor


def load(spark: SparkSession, name: str, folder: str, ticker: str, start: str, end: str | None = None, interval: str = "1d", auto_adjust: bool = True) -> DataFrame:
    """The panel of a source: a registered vendor's, or one of ``SOURCES`` over a folder of tables."""
    if name in VENDORS:
        return VENDORS[name].load(ticker, start, end, interval, auto_adjust)
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}: {sorted([*SOURCES, *VENDORS])}")
    return SOURCES[name](spark, folder)


@dataclass(frozen=True)
class Vendor:
    """A source of raw bars: ``fetch(ticker, start, end, interval, auto_adjust)`` gives a DataFrame."""

    name: str
    fetch: Callable[[str, str, str | None, str, bool], DataFrame]

    def load(self, ticker: str, start: str, end: str | None = None, interval: str = "1d", auto_adjust: bool = True) -> DataFrame:
        raw = self.fetch(ticker, start, end, interval, auto_adjust)
        if raw.isEmpty():
            raise ValueError(f"{self.name} has no rows for {ticker}")
        panel = normalize(raw, ticker).where(F.col("session") >= F.lit(start).cast("date"))
        return panel if end is None else panel.where(F.col("session") < F.lit(end).cast("date"))
