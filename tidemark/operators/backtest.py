"""Cost-aware backtests of position panels keyed by (strategy, ticker, session)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.ranks import scanned
from ..functions.shared import Scratch

KEYS = ("strategy", "ticker")


@dataclass(frozen=True)
class BacktestConfig:
    """``mode``: next_open (in and out every active session) or close_to_close (charged on changes)."""

    mode: str = "next_open"
    round_trip_bps: float = 10.0
    one_way_bps: float = 5.0
    allow_short: bool = False
    threshold: float = 0.55
    short_threshold: float = 0.45
    days: int = 252
    risk_free: float = 0.0

    def __post_init__(self) -> None:
        if self.mode not in ("next_open", "close_to_close"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.allow_short and self.short_threshold > self.threshold:
            raise ValueError("the short threshold exceeds the long one")

    @property
    def cost_rate(self) -> float:
        return (self.round_trip_bps if self.mode == "next_open" else self.one_way_bps) / 10_000


def _w() -> Window:
    return Window.partitionBy(*KEYS).orderBy("session")


def position(config: BacktestConfig = BacktestConfig()) -> Column:
    """Long at the threshold or above, short at the short one or below (which wins where both hold), else flat."""
    long = F.when(F.col("proba_up") >= config.threshold, 1.0).otherwise(0.0)
    return F.when(F.col("proba_up") <= config.short_threshold, -1.0).otherwise(long) if config.allow_short else long


def cost(config: BacktestConfig = BacktestConfig()) -> Column:
    if config.mode == "next_open":
        return F.abs("position") * config.cost_rate
    return F.abs(F.col("position") - F.lag("position", 1, 0.0).over(_w())) * config.cost_rate


def daily(positions: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Returns, equity and drawdown of ``strategy, ticker, session, position, future_return``.

    The peak of the drawdown starts at the first equity, not at one.
    """
    d = positions.withColumn("gross_return", F.col("position") * F.col("future_return")).withColumn("cost", cost(config))
    d = d.withColumn("net_return", F.col("gross_return") - F.col("cost"))
    so_far = _w().rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("equity", F.product(F.col("net_return") + 1).over(so_far)).withColumn("gross_equity", F.product(F.col("gross_return") + 1).over(so_far))
    return d.withColumn("drawdown", F.col("equity") / F.max("equity").over(so_far) - 1)


def curve_in_ranges(days: DataFrame, scratch: Scratch) -> DataFrame:
    """``strategy, ticker, session, equity, drawdown`` of :func:`daily` rows of strategies that no task could sort, by two-level scans."""
    grown = days.select(*KEYS, "session", (F.col("net_return") + 1).alias("_growth"))
    equity = scanned(grown, list(KEYS), ["session"], {"equity": ("product", "_growth")}, scratch)
    peak = scanned(equity.drop("_growth"), list(KEYS), ["session"], {"_peak": ("max", "equity")}, scratch)
    return peak.select(*KEYS, "session", "equity", (F.col("equity") / F.col("_peak") - 1).alias("drawdown"))


def trades(days: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Net return of each trade: an active session, or a stretch of one unchanged position; flat is no trade."""
    if config.mode == "next_open":
        return days.where("position <> 0").select(*KEYS, F.col("session").alias("entry"), F.col("net_return").alias("trade_return"))
    turned = F.when(F.col("position") != F.coalesce(F.lag("position").over(_w()), F.lit(float("inf"))), 1).otherwise(0)
    blocks = days.withColumn("turned", turned).withColumn("block", F.sum("turned").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    closed = blocks.where("position <> 0").groupBy(*KEYS, "block").agg(F.min("session").alias("entry"), (F.product(F.col("net_return") + 1) - 1).alias("trade_return"))
    return closed.select(*KEYS, "entry", "trade_return")


def economic_metrics(days: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """One row a strategy: returns, risk, activity, trades and costs; null where undefined.

    The profit factor of trades that only win is null with ``only_wins`` true.
    """
    active = F.col("position") != 0
    excess = F.col("net_return") - config.risk_free / config.days
    root = math.sqrt(config.days)
    last = lambda c: F.max_by(c, "session")
    n = F.count("*")
    r = F.col("trade_return")
    gains, losses = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    of_trades = [
        F.count(r).alias("n_trades"),
        F.avg(r).alias("average_trade"),
        F.median(r).alias("median_trade"),
        ratio(F.count_if(r > 0).cast("double"), F.count(r)).alias("trade_win_rate"),
        F.max(r).alias("best_trade"),
        F.min(r).alias("worst_trade"),
        ratio(F.coalesce(gains, F.lit(0.0)), losses).alias("profit_factor"),
        F.when(F.count(r) > 0, losses.isNull() & gains.isNotNull()).alias("only_wins"),
    ]
    # trades of single sessions are counted in the same pass
    daily_trades = config.mode == "next_open"
    change = days.withColumns({"changed": (F.col("position") != F.lag("position", 1, 0.0).over(_w())).cast("long"), "trade_return": F.when(active, F.col("net_return"))})
    base = change.groupBy(*KEYS).agg(
        n.alias("n_sessions"),
        (last("equity") - 1).alias("cumulative_return"),
        (last("gross_equity") - 1).alias("gross_cumulative_return"),
        F.when(last("equity") > 0, F.pow(last("equity"), config.days / n) - 1).alias("annualized_return"),
        (F.stddev_samp("net_return") * root).alias("annualized_volatility"),
        (ratio(F.avg(excess), F.stddev_samp(excess)) * root).alias("sharpe"),
        (ratio(F.avg(excess), F.stddev_samp(F.when(excess < 0, excess))) * root).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        F.count_if(active).alias("n_active"),
        F.sum("changed").alias("n_position_changes"),
        ratio(F.count_if(active & (F.col("net_return") > 0)), F.count_if(active)).alias("hit_rate"),
        (F.count_if(active) / n).alias("exposure"),
        F.avg("position").alias("average_position"),
        F.sum("cost").alias("total_cost"),
        F.coalesce(ratio(F.sum("cost"), F.count_if(active)), F.lit(0.0)).alias("cost_per_active"),
        *(of_trades if daily_trades else []),
    )
    if daily_trades:
        return base
    done = trades(days, config).groupBy(*KEYS).agg(*of_trades)
    return base.join(done, list(KEYS), "left").fillna(0, subset=["n_trades"])


def always_active(rows: DataFrame) -> DataFrame:
    return rows.withColumn("strategy", F.lit("always_active")).withColumn("position", F.lit(1.0))


def cash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("strategy", F.lit("cash")).withColumn("position", F.lit(0.0))


def buy_and_hold(panel: DataFrame, index: DataFrame) -> DataFrame:
    """Positions of one purchase held throughout, over the sessions of ``index``.

    The return of a session is the one from the close before into it; sessions
    without one count as zero.  Costs are those of the close_to_close mode.
    """
    w = Window.partitionBy("ticker").orderBy("session")
    into = panel.select("ticker", "session", (ratio("close", F.lag("close").over(w)) - 1).alias("future_return"))
    held = index.select("ticker", "session").join(into, ["ticker", "session"], "left")
    return held.select(F.lit("buy_and_hold").alias("strategy"), "ticker", "session", F.lit(1.0).alias("position"), F.coalesce("future_return", F.lit(0.0)).alias("future_return"))


def rules(predicted: DataFrame, names: tuple[str, ...] = ("last_direction", "always_up")) -> DataFrame:
    """Positions of baselines that trade their own hard ``prediction``, which is what they assert."""
    own = predicted.where(F.col("candidate").isin(list(names)))
    return own.select(F.col("candidate").alias("strategy"), "ticker", "session", F.col("prediction").cast("double").alias("position"), "future_return")


def strategies(scored: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """One position panel from scored rows (``candidate`` becomes the strategy), with the always-active and cash rules."""
    columns = ("strategy", "ticker", "session", "position", "future_return")
    own = scored.withColumn("strategy", F.col("candidate")).withColumn("position", position(config)).select(*columns)
    days = scored.select("ticker", "session", "future_return").distinct()
    return own.unionByName(always_active(days).select(*columns)).unionByName(cash(days).select(*columns))
