"""Positional, chronological splits as ranges over ``row_idx``: never shuffled, never materialised as index lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Folds up to this many are broadcast (some 50 bytes each).
BROADCAST_FOLDS = 200_000


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.60
    validation: float = 0.20
    test: float = 0.20
    n_splits: int = 5
    gap: int = 1

    def __post_init__(self) -> None:
        if abs(self.train + self.validation + self.test - 1.0) > 1e-9 or min(self.train, self.validation, self.test) <= 0:
            raise ValueError("the shares must be positive and sum to one")
        if self.n_splits < 2 or self.gap < 0:
            raise ValueError("two folds at least, and a gap of zero or more")

    @property
    def development(self) -> float:
        return self.train + self.validation


def bounds(sizes: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """``ticker, n_rows`` with ``dev_end`` and ``test_start``; the gap between them is in neither part."""
    dev = F.floor(F.col("n_rows") * F.lit(config.development)).cast("long")
    return sizes.select("ticker", "n_rows", dev.alias("dev_end"), (dev + config.gap).alias("test_start"), F.greatest(F.lit(0), F.col("n_rows") - dev - config.gap).alias("n_test"))


def holdout(sizes: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Train, validation and test ranges with a gap between neighbours."""
    first = F.floor(F.col("n_rows") * F.lit(config.train)).cast("long")
    second = F.floor(F.col("n_rows") * F.lit(config.development)).cast("long")
    gap = config.gap
    parts = F.array(
        F.struct(F.lit("train").alias("part"), F.lit(0).cast("long").alias("start"), first.alias("end")),
        F.struct(F.lit("validation").alias("part"), (first + gap).alias("start"), second.alias("end")),
        F.struct(F.lit("test").alias("part"), (second + gap).alias("start"), F.col("n_rows").alias("end")),
    )
    return sizes.select("ticker", F.explode(parts).alias("p")).select("ticker", "p.*")


def holdout_spans(rows: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """First and last session and number of rows of each part of :func:`holdout`, over a dataset with ``row_idx``."""
    parts = holdout(rows.groupBy("ticker").agg(F.count("*").alias("n_rows")), config)
    held = rows.join(small(parts), "ticker").where((F.col("row_idx") >= F.col("start")) & (F.col("row_idx") < F.col("end")))
    return held.groupBy("ticker", "part").agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count("*").alias("n"))


def assert_holdout_causal(parts: list[dict], gap: int = 0) -> None:
    """Train, validation and test of each ticker (rows of :func:`holdout`) follow each other, ``gap`` rows apart, none empty."""
    by_ticker: dict[str, dict[str, dict]] = {}
    for p in parts:
        by_ticker.setdefault(p["ticker"], {})[p["part"]] = p
    for ticker, of in by_ticker.items():
        for name, p in of.items():
            if p["end"] <= p["start"]:
                raise ValueError(f"{ticker}: the {name} part is empty")
        for a, b in (("train", "validation"), ("validation", "test")):
            if of[b]["start"] < of[a]["end"] + gap:
                raise ValueError(f"{ticker}: {b} does not follow {a} by {gap} rows")


def walk_forward(sizes: DataFrame, config: SplitConfig = SplitConfig(), least_train: int | None = None) -> DataFrame:
    """Expanding folds over ``ticker, n_rows``: fold i trains on [0, train_end) and is evaluated on [eval_start, eval_end).

    The last fold runs to the end.  Folds that train on fewer than
    ``least_train`` rows are left out; a ticker too short for its folds has none.
    """
    k, gap = config.n_splits, config.gap
    size = F.floor((F.col("n_rows") - gap) / (k + 1)).cast("long")
    rows = sizes.select("ticker", "n_rows", size.alias("size")).where("size > 0").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    train_end = F.col("size") * F.col("fold")
    rows = rows.select("ticker", F.col("fold").cast("long").alias("fold"), train_end.alias("train_end"), (train_end + gap).alias("eval_start"), F.when(F.col("fold") == k, F.col("n_rows")).otherwise(train_end + gap + F.col("size")).alias("eval_end"))
    return rows if least_train is None else rows.where(F.col("train_end") >= least_train)


def development_folds(rows: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Folds within the development part of a dataset with ``row_idx`` and ``n_rows``."""
    sizes = rows.groupBy("ticker").agg(F.count("*").alias("n_rows"))
    dev = bounds(sizes, config).select("ticker", F.col("dev_end").alias("n_rows"))
    return small(walk_forward(dev, config))


def small(folds: DataFrame) -> DataFrame:
    """Folds to be broadcast where they are few (some rows a ticker): the rows beside them may have few, hot tickers."""
    return F.broadcast(folds) if folds.count() <= BROADCAST_FOLDS else folds


def fold_rows(rows: DataFrame, folds: DataFrame, part: str) -> DataFrame:
    """Rows of each fold's ``part`` (train or eval), by a range predicate.

    Folds are a few rows a ticker, and the join is an equi-join on the ticker
    with a range filter, so each row is repeated for its folds only.
    """
    start, end = (F.lit(0), F.col("train_end")) if part == "train" else (F.col("eval_start"), F.col("eval_end"))
    return rows.join(folds, "ticker").where((F.col("row_idx") >= start) & (F.col("row_idx") < end))


def fold_spans(rows: DataFrame, folds: DataFrame) -> DataFrame:
    out = fold_rows(rows, folds, "eval").groupBy("ticker", "fold").agg(F.min("session").alias("eval_first"), F.max("session").alias("eval_last"), F.count("*").alias("n_eval"))
    train = fold_rows(rows, folds, "train").groupBy("ticker", "fold").agg(F.min("session").alias("train_first"), F.max("session").alias("train_last"), F.count("*").alias("n_train"))
    return train.join(out, ["ticker", "fold"])


def causality(folds: DataFrame, gap: int = 0) -> DataFrame:
    """``folds`` with ``after_train`` (evaluated ``gap`` rows behind the train part at least), ``in_order`` (behind the fold before) and ``filled`` (not empty)."""
    before = F.lag("eval_end").over(Window.partitionBy("ticker").orderBy("fold"))
    return folds.select("*", (F.col("eval_start") >= F.col("train_end") + gap).alias("after_train"), F.coalesce(F.col("eval_start") >= before, F.lit(True)).alias("in_order"), (F.col("eval_end") > F.col("eval_start")).alias("filled"))


def holdout_causality(parts: DataFrame, gap: int = 0) -> DataFrame:
    """Parts of :func:`holdout` with ``follows`` (``gap`` rows behind the part before) and ``filled``."""
    before = F.lag("end").over(Window.partitionBy("ticker").orderBy("start"))
    return parts.select("*", F.coalesce(F.col("start") >= before + gap, F.lit(True)).alias("follows"), (F.col("end") > F.col("start")).alias("filled"))


def assert_causal(folds: list[dict], gap: int) -> None:
    """Each fold is evaluated after its train part and the gap, folds do not overlap and end in order."""
    last = 0
    for f in sorted(folds, key=lambda f: f["fold"]):
        if f["eval_start"] < f["train_end"] + gap or f["eval_end"] <= f["eval_start"] or f["eval_start"] < last:
            raise ValueError(f"fold {f['fold']} is not causal")
        last = f["eval_end"]
