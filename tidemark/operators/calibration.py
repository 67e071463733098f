"""Reliability of probabilities and choice of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio

N_BINS = 10
CANDIDATES = tuple(round(0.30 + 0.01 * i, 2) for i in range(41))


def bin_id(p: Column | str = "proba_up", n: int = N_BINS) -> Column:
    """Fixed-width bin of a probability; 1 lies in the last.  Outside 0 to 1 it fails."""
    p = F.col(p) if isinstance(p, str) else p
    inside = F.when((p < 0) | (p > 1), F.raise_error(F.lit("probability outside 0 to 1"))).otherwise(p)
    return F.least(F.floor(inside * n), F.lit(n - 1)).cast("long")


def calibration_bins(scored: DataFrame, keys: tuple[str, ...], n: int = N_BINS) -> DataFrame:
    """Non-empty bins with mean probability, observed frequency and their gap."""
    b = scored.withColumn("bin_id", bin_id(n=n)).groupBy(*keys, "bin_id").agg(F.count("*").alias("n"), F.avg("proba_up").alias("mean_predicted"), F.avg("target").alias("observed"))
    gap = F.abs(F.col("mean_predicted") - F.col("observed"))
    return b.select(*keys, "bin_id", (F.col("bin_id") / n).alias("lower"), ((F.col("bin_id") + 1) / n).alias("upper"), "n", "mean_predicted", "observed", gap.alias("gap"), (gap * gap).alias("squared_gap"))


def calibration_errors(scored: DataFrame, keys: tuple[str, ...], n: int = N_BINS) -> DataFrame:
    """Expected and maximum calibration error."""
    b = calibration_bins(scored, keys, n)
    return b.groupBy(*keys).agg(F.sum("n").alias("n"), ratio(F.sum(F.col("n") * F.col("gap")), F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def calibration_report(scored: DataFrame, keys: tuple[str, ...], n: int = N_BINS) -> DataFrame:
    rate = F.avg("target")
    whole = scored.groupBy(*keys).agg(
        F.avg(F.pow(F.col("proba_up") - F.col("target"), 2)).alias("brier"),
        (rate * (F.lit(1.0) - rate)).alias("base_rate_brier"),
        F.min("proba_up").alias("least"),
        F.max("proba_up").alias("greatest"),
        F.avg("proba_up").alias("mean"),
        F.stddev_samp("proba_up").alias("std"),
    )
    return whole.join(calibration_errors(scored, keys, n), list(keys))


def histogram(scored: DataFrame, keys: tuple[str, ...], bins: int = 40) -> DataFrame:
    """Counts of probabilities over the range of the data; the greatest lies in the last bin."""
    span = scored.groupBy(*keys).agg(F.min("proba_up").alias("low"), F.max("proba_up").alias("high"))
    place = F.coalesce(F.floor(ratio(F.col("proba_up") - F.col("low"), F.col("high") - F.col("low")) * bins), F.lit(0))
    return scored.join(span, list(keys)).groupBy(*keys, F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def threshold_scan(scored: DataFrame, keys: tuple[str, ...], candidates: tuple[float, ...] = CANDIDATES) -> DataFrame:
    """Accuracy, balanced accuracy and F1 of every threshold.

    Rows are first counted by distinct score, so the candidates multiply
    scores, not rows.
    """
    counts = scored.groupBy(*keys, "proba_up").agg(F.count_if(F.col("target") == 1).cast("double").alias("pos"), F.count_if(F.col("target") == 0).cast("double").alias("neg"))
    each = counts.withColumn("threshold", F.explode(F.array(*[F.lit(c) for c in candidates])))
    up = F.col("proba_up") >= F.col("threshold")
    total = lambda c, test: F.sum(F.when(test, F.col(c)).otherwise(0.0))
    s = each.groupBy(*keys, "threshold").agg(total("pos", up).alias("tp"), total("neg", up).alias("fp"), total("neg", ~up).alias("tn"), total("pos", ~up).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    recall, other = ratio(tp, tp + fn), ratio(tn, tn + fp)
    balanced = F.when(recall.isNotNull() & other.isNotNull(), (recall + other) / 2).otherwise(F.coalesce(recall, other))
    f_up, f_down = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    f1 = F.when(f_up.isNotNull() & f_down.isNotNull(), (f_up + f_down) / 2).otherwise(F.coalesce(f_up, f_down))
    return s.select(*keys, "threshold", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), balanced.alias("balanced_accuracy"), f1.alias("f1_macro"))


def net_sharpe_scan(scored: DataFrame, keys: tuple[str, ...], cost_rate: float, intraday: bool = True, candidates: tuple[float, ...] = CANDIDATES, days: int = 252) -> DataFrame:
    """Annualised Sharpe ratio, after costs, of a long-or-cash rule at every threshold."""
    each = scored.withColumn("threshold", F.explode(F.array(*[F.lit(c) for c in candidates])))
    each = each.withColumn("position", (F.col("proba_up") >= F.col("threshold")).cast("double"))
    w = Window.partitionBy(*keys, "threshold").orderBy("session")
    cost = (F.col("position") if intraday else F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w))) * cost_rate
    net = each.select(*keys, "threshold", (F.col("position") * F.col("future_return") - cost).alias("net"))
    return net.groupBy(*keys, "threshold").agg((ratio(F.avg("net"), F.stddev_samp("net")) * (days**0.5)).alias("net_sharpe"))


def best_threshold(scan: DataFrame, keys: tuple[str, ...], objective: str = "balanced_accuracy", fallback: float = 0.5) -> DataFrame:
    """The threshold of the highest objective, of equal ones the lowest; the fallback if it is never defined."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.round(objective, 8)), "threshold")
    first = scan.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return first.select(*keys, F.when(F.col(objective).isNull(), F.lit(fallback)).otherwise(F.col("threshold")).alias("threshold"), F.col(objective).alias("score"))
