"""Classification metrics of scored rows, all groups at once.

Counts and sums of a group come from one aggregation.  Rank metrics first
reduce a group to its distinct scores, so their windows run over scores, not
rows, and order scores in a shuffle by group.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, ratio
from ..functions.ranks import running
from ..functions.shared import Scratch

KEYS = ("candidate", "ticker", "fold")
METRICS = ("accuracy", "balanced_accuracy", "f1_macro", "precision_up", "recall_up", "mcc", "brier", "log_loss", "roc_auc", "pr_auc")
#: Degrees of freedom up to which a t quantile is taken from a table of exact ones; beyond, from its expansion.
MOST_DEGREES = 200


def t_quantile(degrees: int, level: float = 0.95) -> float:
    """Two-sided Student t quantile: bisection of the distribution function, which is a finite sum (no SciPy)."""

    def inside(t: float) -> float:
        """Chance of a value between -t and t."""
        angle = math.atan(t / math.sqrt(degrees))
        square = math.cos(angle) ** 2
        if degrees % 2:
            term, total = math.cos(angle), 0.0
            for k in range(1, (degrees - 1) // 2 + 1):
                total += term
                term *= square * 2 * k / (2 * k + 1)
            return 2 / math.pi * (angle + math.sin(angle) * total)
        term, total = 1.0, 0.0
        for k in range(1, degrees // 2 + 1):
            total += term
            term *= square * (2 * k - 1) / (2 * k)
        return math.sin(angle) * total

    low, high = 0.0, 1.0
    while inside(high) < level:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < level else (low, middle)
    return (low + high) / 2


def t_column(degrees: Column, level: float = 0.95) -> Column:
    """The quantile as an expression over degrees of freedom: table, then Fisher's expansion about the normal one."""
    table = F.array(*[F.lit(t_quantile(d, level)) for d in range(1, MOST_DEGREES + 1)])
    z = NormalDist().inv_cdf(0.5 + level / 2)
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    n = degrees.cast("double")
    far = F.lit(z)
    for k, term in enumerate(terms, 1):
        far = far + F.lit(term) / F.pow(n, F.lit(float(k)))
    return F.when(degrees < 1, None).when(degrees <= MOST_DEGREES, F.get(table, (degrees - 1).cast("int"))).otherwise(far)


def _sum(test: Column) -> Column:
    return F.count_if(test).cast("double")


def threshold_metrics(scored: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Metrics of the hard predictions and the proper scores; null where a class is absent."""
    y, h, p = F.col("target") == 1, F.col("prediction") == 1, clip(F.col("proba_up"), 1e-9, 1 - 1e-9)
    c = scored.groupBy(*keys).agg(
        F.count("*").alias("n"),
        _sum(y & h).alias("tp"),
        _sum(~y & h).alias("fp"),
        _sum(~y & ~h).alias("tn"),
        _sum(y & ~h).alias("fn"),
        F.avg(F.pow(F.col("proba_up") - F.col("target"), 2)).alias("brier"),
        F.avg(-F.when(y, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))).alias("log_loss"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    up, down = ratio(tp, tp + fn), ratio(tn, tn + fp)
    f_up, f_down = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    mean = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))
    margin = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    one_class = (tp + fn == 0) | (tn + fp == 0)
    return c.select(
        *keys,
        "n",
        "tp",
        "fp",
        "tn",
        "fn",
        ratio(tp + tn, F.col("n").cast("double")).alias("accuracy"),
        mean(up, down).alias("balanced_accuracy"),
        mean(f_up, f_down).alias("f1_macro"),
        F.coalesce(ratio(tp, tp + fp), F.lit(0.0)).alias("precision_up"),
        F.coalesce(up, F.lit(0.0)).alias("recall_up"),
        F.when(~one_class, F.coalesce(ratio(tp * tn - fp * fn, margin), F.lit(0.0))).alias("mcc"),
        "brier",
        "log_loss",
    )


def by_score(scored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct scores of each group, highest first, with running counts ``tps`` and ``fps`` and totals."""
    scores = scored.groupBy(*keys, "proba_up").agg(F.count_if(F.col("target") == 1).cast("double").alias("pos"), F.count_if(F.col("target") == 0).cast("double").alias("neg"))
    down = Window.partitionBy(*keys).orderBy(F.desc("proba_up")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return scores.select("*", F.sum("pos").over(down).alias("tps"), F.sum("neg").over(down).alias("fps"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("q"))


def by_score_in_ranges(scored: DataFrame, keys: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """:func:`by_score` for groups with any number of distinct scores: none is sorted in one task."""
    scores = scored.groupBy(*keys, "proba_up").agg(F.count_if(F.col("target") == 1).cast("double").alias("pos"), F.count_if(F.col("target") == 0).cast("double").alias("neg"))
    found = running(scores.withColumn("_down", -F.col("proba_up")), list(keys), ["_down"], {"tps": "pos", "fps": "neg"}, scratch)
    return found.drop("_down").withColumnsRenamed({"tps_all": "p", "fps_all": "q"})


def rank_metrics(scored: DataFrame, keys: tuple[str, ...] = KEYS, scratch: Scratch | None = None) -> DataFrame:
    """``roc_auc`` (ties count half) and ``pr_auc`` (average precision by steps); null where a class is absent.

    With ``scratch`` the scores of a group are taken in ranges: for millions of distinct ones.
    """
    s = by_score(scored, keys) if scratch is None else by_score_in_ranges(scored, keys, scratch)
    wins = F.col("pos") * (F.col("q") - F.col("fps")) + F.col("pos") * F.col("neg") / 2
    steps = F.col("pos") * F.col("tps") / (F.col("tps") + F.col("fps"))
    a = s.groupBy(*keys).agg(F.sum(wins).alias("wins"), F.sum(steps).alias("steps"), F.max("p").alias("p"), F.max("q").alias("q"))
    two = (F.col("p") > 0) & (F.col("q") > 0)
    return a.select(*keys, F.when(two, ratio(F.col("wins"), F.col("p") * F.col("q"))).alias("roc_auc"), F.when(two, ratio("steps", "p")).alias("pr_auc"))


def metric_suite(scored: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return threshold_metrics(scored, keys).join(rank_metrics(scored, keys), list(keys))


def roc_points(scored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return by_score(scored, keys).select(*keys, F.col("proba_up").alias("threshold"), ratio("fps", "q").alias("fpr"), ratio("tps", "p").alias("tpr"))


def pr_points(scored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    s = by_score(scored, keys)
    return s.select(*keys, F.col("proba_up").alias("threshold"), ratio("tps", "p").alias("recall"), ratio(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"), ratio(F.col("p"), F.col("p") + F.col("q")).alias("base_rate"))


def confusion(scored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Actual class by predicted class."""
    return scored.groupBy(*keys, F.col("target").alias("actual")).agg(F.count_if(F.col("prediction") == 0).alias("predicted_down"), F.count_if(F.col("prediction") == 1).alias("predicted_up"))


def long_metrics(suite: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row for each group and metric."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    return suite.select(*keys, each.alias("m")).select(*keys, "m.*")


def t_interval(values: DataFrame, keys: tuple[str, ...], value: str = "value", level: float = 0.95) -> DataFrame:
    """Mean, sample deviation, extremes and Student interval of finite values.

    One value has deviation zero and no interval; none has nothing.
    """
    x = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    a = values.groupBy(*keys).agg(F.count(x).alias("n_values"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("s"), F.min(x).alias("least"), F.max(x).alias("greatest"))
    n = F.col("n_values")
    half = F.when(n > 1, t_column(n - 1, level) * F.col("s") / F.sqrt(n))
    return a.select(*keys, "n_values", "mean", F.when(n == 1, 0.0).otherwise(F.col("s")).alias("std"), "least", "greatest", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def fold_aggregate(suite: DataFrame) -> DataFrame:
    """Metrics of each candidate over its folds."""
    return t_interval(long_metrics(suite), ("candidate", "ticker", "metric"))


def excludes(low: float | None, high: float | None, value: float) -> bool:
    """Whether an interval rules a value out; an unknown interval rules nothing out."""
    return low is not None and high is not None and not low <= value <= high


def compare_sentence(models: dict[str, float], baselines: dict[str, float], metric: str = "balanced_accuracy") -> str:
    """Best model against best baseline in words."""
    model, base = max(models, key=models.get), max(baselines, key=baselines.get)
    verb = "beats" if models[model] > baselines[base] else "does not beat"
    return f"{model} ({metric} {models[model]:.4f}) {verb} {base} ({baselines[base]:.4f})"
