"""Labels: the only place that looks ahead."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import by_session, finite, ratio
from .features import FeatureConfig, build_features, feature_columns


@dataclass(frozen=True)
class LabelConfig:
    """``definition``: open_to_close (tradable at the next open) or close_to_close."""

    definition: str = "open_to_close"
    horizon: int = 1

    def __post_init__(self) -> None:
        if self.definition not in ("open_to_close", "close_to_close"):
            raise ValueError(f"unknown label definition {self.definition!r}")
        if self.horizon < 1 or self.definition == "open_to_close" and self.horizon != 1:
            raise ValueError("open_to_close needs a horizon of 1, close_to_close one of 1 or more")


def future_return(config: LabelConfig = LabelConfig()) -> Column:
    w = by_session()
    later = F.lead("close", config.horizon).over(w)
    start = F.col("close") if config.definition == "close_to_close" else F.lead("open", 1).over(w)
    return finite(ratio(later, start) - 1)


def target(future: str = "future_return") -> Column:
    """1 if the price rises, 0 if not (no change included), null if unknown."""
    return F.when(F.col(future).isNotNull(), (F.col(future) > 0).cast("int"))


def with_labels(panel: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    return panel.withColumn("future_return", future_return(config)).withColumn("target", target())


def drop_unlabeled_tail(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """Without the last ``horizon`` sessions of each ticker; nothing is left of shorter ones."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session")))
    return panel.withColumn("_place", place).where(F.col("_place") > horizon).drop("_place")


def label_summary(labeled: DataFrame) -> DataFrame:
    return labeled.groupBy("ticker").agg(
        F.count("target").alias("n_labeled"),
        F.count_if(F.col("target") == 1).alias("n_up"),
        F.count_if(F.col("target") == 0).alias("n_down"),
        F.avg("target").alias("up_rate"),
        F.avg("future_return").alias("mean_return"),
    )


def build_dataset(panel: DataFrame, features: FeatureConfig = FeatureConfig(), labels: LabelConfig = LabelConfig(), min_rows: int = 0) -> DataFrame:
    """Features and labels of all complete rows, with ``row_idx`` and ``n_rows`` of the ticker.

    Features and labels are one projection over the same windows, so there is
    no join.  ``min_rows`` counts complete rows and is checked if positive.
    """
    if min_rows and min_rows <= features.warm_up() + labels.horizon + 1:
        raise ValueError("min_rows must exceed the warm-up")
    carried = with_labels(panel, labels)
    rows = build_features(carried, features, keep=("open", "close", "future_return", "target"))
    rows = rows.dropna("any", subset=["future_return", "target", *feature_columns(features)])
    rows = rows.withColumn("row_idx", (F.row_number().over(by_session()) - 1).cast("long")).withColumn("n_rows", F.count("*").over(Window.partitionBy("ticker")))
    if min_rows:
        few = rows.groupBy("ticker").count().where(F.col("count") < min_rows).first()
        if few or rows.isEmpty():
            raise ValueError(f"{few['ticker'] if few else 'the panel'} has fewer than {min_rows} complete rows")
    return rows


def dataset_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.avg("target").alias("up_rate"))
