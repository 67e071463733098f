"""Trivial predictors: fitting is an aggregate of the train part, predicting a projection of the eval part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip
from .folds import fold_rows

BASELINES = ("majority_class", "always_up", "random", "last_direction")
EDGE = 1e-6


def direction_feature(definition: str = "open_to_close") -> str:
    """The feature whose sign the last-direction rule follows."""
    return "open_to_close_return" if definition == "open_to_close" else "return_1d"


def fitted(train: DataFrame, keys: tuple[str, ...], feature: str) -> DataFrame:
    """By key: share of rises (0.5 without rows), and share of rises by the direction of ``feature``."""
    up = F.col(feature) > 0
    return train.groupBy(*keys).agg(
        F.coalesce(F.avg("target"), F.lit(0.5)).alias("prior"),
        F.coalesce(F.avg(F.when(up, F.col("target"))), F.avg("target"), F.lit(0.5)).alias("up_after_up"),
        F.coalesce(F.avg(F.when(~F.coalesce(up, F.lit(False)), F.col("target"))), F.avg("target"), F.lit(0.5)).alias("up_after_down"),
    )


def predicted(rows: DataFrame, feature: str, seed: int = 42) -> DataFrame:
    """Four rows for each row: ``candidate, proba_up, prediction`` of every baseline.

    The random rule draws from a hash of seed, ticker and row, so a draw does
    not depend on partitions.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ticker"), F.col("row_idx").cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    up = F.coalesce(F.col(feature) > 0, F.lit(False))
    prior = clip(F.col("prior"), EDGE, 1 - EDGE)
    after = clip(F.when(up, F.col("up_after_up")).otherwise(F.col("up_after_down")), EDGE, 1 - EDGE)
    rules = {
        "majority_class": (prior, (F.col("prior") >= 0.5).cast("int")),
        "always_up": (prior, F.lit(1)),
        "random": (prior, (draw < F.col("prior")).cast("int")),
        "last_direction": (after, up.cast("int")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), p.alias("proba_up"), h.alias("prediction")) for n, (p, h) in rules.items()]))
    return rows.withColumn("_b", each).select("*", "_b.*").drop("_b")


def baseline_oof(rows: DataFrame, folds: DataFrame, definition: str = "open_to_close", seed: int = 42) -> DataFrame:
    """Out-of-fold predictions of all baselines: fitted on each fold's train part only."""
    feature = direction_feature(definition)
    fit = fitted(fold_rows(rows, folds, "train"), ("ticker", "fold"), feature)
    scored = predicted(fold_rows(rows, folds, "eval").join(fit, ["ticker", "fold"]), feature, seed)
    return scored.select("candidate", "ticker", "fold", "session", "row_idx", "proba_up", "prediction", "target", "future_return")


def reversion_oof(rows: DataFrame, folds: DataFrame, strength: float = 20.0) -> DataFrame:
    """A rule with graded scores: the further the last session fell, the likelier a rise."""
    p = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("open_to_close_return") * strength)), 8)
    scored = fold_rows(rows, folds, "eval").select(F.lit("reversion").alias("candidate"), "ticker", "fold", "session", "row_idx", p.alias("proba_up"), "target", "future_return")
    return scored.select("candidate", "ticker", "fold", "session", "row_idx", "proba_up", (F.col("proba_up") >= 0.5).cast("int").alias("prediction"), "target", "future_return")
