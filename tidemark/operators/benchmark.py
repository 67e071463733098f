"""Alignment of a panel with a benchmark, and lookups in session calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_benchmark(panel: DataFrame, asset: str, benchmark: str) -> tuple[DataFrame, DataFrame]:
    bench = panel.where(F.col("ticker") == benchmark).select("session", F.col("close").alias("bench_close"))
    return panel.where(F.col("ticker") == asset), bench


def align(asset: DataFrame, bench: DataFrame) -> DataFrame:
    """Sessions of both, nothing filled forward."""
    return asset.join(bench, "session")


def lost_sessions(asset: DataFrame, bench: DataFrame) -> DataFrame:
    return asset.join(bench, "session", "left_anti").select("ticker", "session")


def alignment_audit(asset: DataFrame, bench: DataFrame, shown: int = 50) -> DataFrame:
    """One row: sessions before and after, the share lost, and the first ``shown`` lost ones."""
    marked = asset.join(bench.withColumn("met", F.lit(True)), "session", "left")
    first = marked.where("met is null").select(F.col("session").cast("string").alias("lost")).orderBy("lost").limit(shown)
    listed = first.agg(F.array_join(F.array_sort(F.collect_list("lost")), ",").alias("lost_sessions"), F.lit(1).alias("_one"))
    counts = marked.agg(
        F.lit(1).alias("_one"),
        F.count("*").alias("n_before"),
        F.count("met").alias("n_after"),
        F.count_if(F.col("met").isNull()).alias("n_lost"),
        F.try_divide(F.count_if(F.col("met").isNull()).cast("double"), F.count("*")).alias("lost_share"),
    )
    return counts.join(listed, "_one").drop("_one")


def align_checked(asset: DataFrame, bench: DataFrame, most_lost: float = 0.02) -> DataFrame:
    """:func:`align`, refused if more than ``most_lost`` of the sessions go."""
    share = alignment_audit(asset, bench).first()["lost_share"]
    if share is None or share > most_lost:
        raise ValueError(f"the benchmark lacks {share if share is not None else 1:.1%} of the sessions")
    return align(asset, bench)


def last_at_or_before(sessions: DataFrame, moments: DataFrame) -> DataFrame:
    """For each ``moment`` the last ``session`` that is not after it (a backward as-of join by range).

    One ordered pass over both: no pairs of moments and sessions are made.
    """
    from pyspark.sql import Window

    both = sessions.select("ticker", F.col("session").alias("at"), F.col("session"), F.lit(0).alias("kind")).unionByName(
        moments.select("ticker", F.col("moment").alias("at"), F.lit(None).cast("date").alias("session"), F.lit(1).alias("kind"))
    )
    w = Window.partitionBy("ticker").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("signal", F.last("session", ignorenulls=True).over(w)).where("kind = 1").select("ticker", F.col("at").alias("moment"), "signal")


def next_sessions(sessions: DataFrame) -> DataFrame:
    """Each session with the one after it; the last has null."""
    from pyspark.sql import Window

    return sessions.select("ticker", "session", F.lead("session").over(Window.partitionBy("ticker").orderBy("session")).alias("next_session"))


def resolve_signal(available: DataFrame, last_completed: str, as_of: str | None = None) -> str:
    """The session to predict from: the last available one that is completed, or exactly ``as_of``."""
    limit = as_of or last_completed
    row = available.where(F.col("session") <= F.lit(limit).cast("date")).agg(F.max("session").alias("s")).first()
    if row["s"] is None:
        raise ValueError(f"no session up to {limit}")
    if as_of and str(row["s"]) != as_of:
        raise ValueError(f"{as_of} has no features; the nearest earlier session is {row['s']}")
    return str(row["s"])
