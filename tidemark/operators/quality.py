"""Duplicate resolution, validation and completeness of bar panels."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import by_session, ratio
from ..sources.panels import BAR_COLUMNS

KEYS = ("ticker", "session")
#: The five ways in which a bar's prices can contradict each other.
GEOMETRY = ("high_below_low", "high_below_open", "high_below_close", "low_above_open", "low_above_close")


def conflicts(panel: DataFrame) -> DataFrame:
    """Keys with rows that disagree (nulls agree with nulls), and how many versions they have."""
    versions = panel.groupBy(*KEYS).agg(F.count_distinct(F.struct(*BAR_COLUMNS)).alias("n_versions"))
    return versions.where("n_versions > 1")


def resolve_duplicates(panel: DataFrame, collapse: bool = True) -> tuple[DataFrame, int]:
    """Collapse rows that repeat in full and count them; rows of a key that disagree are an error."""
    counts = panel.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*BAR_COLUMNS)).alias("v"))
    found = counts.agg(F.sum(F.col("n") - 1).alias("extra"), F.count_if(F.col("v") > 1).alias("bad")).first()
    if found["bad"]:
        raise ValueError(f"{found['bad']} sessions have conflicting rows")
    extra = int(found["extra"] or 0)
    if extra and not collapse:
        raise ValueError(f"{extra} repeated rows")
    return panel.dropDuplicates(list(KEYS)), extra


def violations(panel: DataFrame) -> DataFrame:
    """Bars whose prices contradict each other, one row for each contradiction."""
    slack = F.greatest(F.abs("close"), F.lit(1e-12)) * 1e-8
    tests = {
        "high_below_low": F.col("high") < F.col("low") - slack,
        "high_below_open": F.col("high") < F.col("open") - slack,
        "high_below_close": F.col("high") < F.col("close") - slack,
        "low_above_open": F.col("low") > F.col("open") + slack,
        "low_above_close": F.col("low") > F.col("close") + slack,
    }
    kinds = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return panel.select(*KEYS, F.explode(kinds).alias("violation"))


def with_moves(panel: DataFrame) -> DataFrame:
    """The panel with ``move`` (close to close) and ``gap_days`` since the session before."""
    w = by_session()
    return panel.select("*", (ratio("close", F.lag("close").over(w)) - 1).alias("move"), F.datediff("session", F.lag("session").over(w)).alias("gap_days"))


def large_moves(panel: DataFrame, threshold: float = 0.25) -> DataFrame:
    return with_moves(panel).where(F.abs("move") > threshold)


def gaps(panel: DataFrame, days: int = 10) -> DataFrame:
    """Sessions more than ``days`` after the one before."""
    return with_moves(panel).where(F.col("gap_days") > days)


def quality_report(panel: DataFrame, threshold: float = 0.25) -> DataFrame:
    """One row a ticker: sizes, spans, defects and missing shares, in one pass after one window."""
    moved = with_moves(panel)
    bad = violations(panel).groupBy("ticker").agg(*[F.count_if(F.col("violation") == k).alias(k) for k in GEOMETRY])
    base = moved.groupBy("ticker").agg(
        F.count("*").alias("n_rows"),
        F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
        F.count_if((F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)).alias("n_not_positive"),
        F.count_if(F.col("volume") < 0).alias("n_negative_volume"),
        F.count_if(F.col("volume") == 0).alias("n_zero_volume"),
        F.count_if(F.abs("move") > threshold).alias("n_large_moves"),
        F.max("gap_days").cast("long").alias("max_gap_days"),
        *[(F.count_if(F.col(c).isNull()) / F.count("*")).alias(f"missing_{c}") for c in BAR_COLUMNS],
    )
    return base.join(bad, "ticker", "left").fillna(0, subset=list(GEOMETRY))


def first_sessions(panel: DataFrame, threshold: float = 0.25, moves: int = 20, silent: int = 5) -> DataFrame:
    """``ticker, large_moves, zero_volume``: the first sessions of either kind, as text, so many at most."""
    moved = with_moves(panel)
    kinds = {"large_moves": (F.abs("move") > threshold, moves), "zero_volume": (F.col("volume") == 0, silent)}
    each = moved.select(*KEYS, F.explode(F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, (test, _) in kinds.items()]))).alias("kind"))
    place = F.row_number().over(Window.partitionBy("ticker", "kind").orderBy("session"))
    most = F.when(F.col("kind") == "large_moves", moves).otherwise(silent)
    few = each.withColumn("place", place).where(F.col("place") <= most)
    listed = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("session").cast("string")))), ",").alias(k) for k in kinds]
    return panel.select("ticker").distinct().join(few.groupBy("ticker").agg(*listed), "ticker", "left").fillna("", list(kinds))


def describe(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``ticker, name``: count, mean, deviation, least, quartiles and greatest of each column, in one aggregation."""
    long = frame.select("ticker", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("ticker", "e.*")
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return long.groupBy("ticker", "name").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("greatest"), *[F.percentile("x", F.lit(q)).alias(n) for n, q in quartiles.items()]
    )


def validate(panel: DataFrame, min_rows: int = 1000, full_ohlc: bool = True, threshold: float = 0.25) -> list[dict]:
    """The report of every ticker; raises on a defect that makes a panel unusable."""
    missing = {*KEYS, *BAR_COLUMNS} - {c.lower() for c in panel.columns}
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    n, keys = panel.agg(F.count("*"), F.count_distinct(*KEYS)).first()
    if n != keys:
        raise ValueError("sessions repeat")
    reports = [r.asDict() for r in quality_report(panel, threshold).collect()]
    if not reports:
        raise ValueError("no rows")
    for r in reports:
        if r["n_rows"] < min_rows:
            raise ValueError(f"{r['ticker']}: {r['n_rows']} rows, {min_rows} needed")
        if r["n_not_positive"] or r["n_negative_volume"]:
            raise ValueError(f"{r['ticker']}: prices must be positive and volume not negative")
        if full_ohlc and any(r[f"missing_{c}"] for c in ("open", "high", "low", "close")):
            raise ValueError(f"{r['ticker']}: incomplete prices")
        if any(r[k] for k in GEOMETRY):
            raise ValueError(f"{r['ticker']}: prices contradict each other")
        r["warnings"] = [f"{r['max_gap_days']} days without a session"] if (r["max_gap_days"] or 0) > 10 else []
    return reports


@dataclass(frozen=True)
class PartialBar:
    """Whether the last bar is of a session that is still open, and why."""

    drop: bool
    reason: str


def decide_partial_bar(last: date, closes: dict[date, datetime], now: datetime, explicit_end: date | None = None, enabled: bool = True) -> PartialBar:
    """``closes``: close time of each session.  The last bar goes only if its session has not closed by ``now``."""
    if not enabled:
        return PartialBar(False, "disabled")
    if explicit_end is not None:
        return PartialBar(False, "explicit end")
    if last not in closes:
        return PartialBar(False, "not a session")
    return PartialBar(True, "session open") if now < closes[last] else PartialBar(False, "session closed")


def drop_open_session(panel: DataFrame, closed_before: str) -> DataFrame:
    """Rows of sessions that ended by the given moment (a date's session ends with the day)."""
    return panel.where(F.col("session") < F.lit(closed_before).cast("date"))


def assert_no_leakage(columns: list[str]) -> None:
    """Features may not contain the label or anything of the future."""
    bad = [c for c in columns if c.lower() == "target" or c.lower().startswith("future_")]
    if bad:
        raise ValueError(f"columns of the future among the features: {bad}")


def assert_chronological(panel: DataFrame) -> None:
    if not panel.groupBy(*KEYS).count().where("count > 1").isEmpty():
        raise ValueError("sessions repeat")


def assert_finite(frame: DataFrame, columns: list[str], context: str = "features") -> None:
    """Names the columns that hold null, NaN or infinity."""
    row = frame.agg(*[F.max(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns]).first()
    bad = [c for c in columns if row[c]]
    if bad:
        raise ValueError(f"{context}: not finite: {bad}")
