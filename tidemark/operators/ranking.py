"""Total order of candidates and the gate that a winner must pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import t_column

#: Metrics of a candidate's summary by their short names.
SUMMARY = {"ba": "balanced_accuracy", "log_loss": "log_loss", "auc": "roc_auc", "mcc": "mcc", "brier": "brier", "accuracy": "accuracy"}


@dataclass(frozen=True)
class GateConfig:
    margin: float = 0.01
    fold_wins: int = 4
    least_auc: float = 0.5
    least_mcc: float = 0.0


@dataclass(frozen=True)
class Standing:
    """What the ranking knows of a candidate besides its scores: smaller is simpler."""

    complexity: int = 0
    simplicity: tuple[float, ...] = ()


def _by_name(values: Mapping[str, Column], default: Column) -> Column:
    """The value of a row's candidate."""
    out = default
    for name, value in values.items():
        out = F.when(F.col("candidate") == name, value).otherwise(out)
    return out


def summary(suite: DataFrame, standings: Mapping[str, Standing] = {}) -> DataFrame:
    """Means over folds by candidate with deviations and the interval of the main score, and what else ranks it."""
    aggregates = []
    for short, metric in SUMMARY.items():
        aggregates += [F.avg(metric).alias(f"mean_{short}"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias(f"std_{short}")]
    n = F.count("balanced_accuracy")
    s = suite.groupBy("ticker", "candidate").agg(*aggregates, n.alias("n_folds"), F.map_from_entries(F.collect_list(F.struct("fold", F.round("balanced_accuracy", 8)))).alias("folds"))
    half = F.when(F.col("n_folds") > 1, t_column(F.col("n_folds") - 1) * F.col("std_ba") / F.sqrt("n_folds"))
    s = s.withColumns({"low_ba": F.col("mean_ba") - half, "high_ba": F.col("mean_ba") + half})
    complexity = _by_name({k: F.lit(v.complexity) for k, v in standings.items()}, F.lit(0))
    simplicity = _by_name({k: F.array(*[F.lit(float(x)) for x in v.simplicity]).cast("array<double>") for k, v in standings.items()}, F.array().cast("array<double>"))
    return s.withColumns({"complexity": complexity.cast("long"), "simplicity": simplicity})


def _order() -> list[Column]:
    """Score down, deviation, loss, complexity and simplicity up, then name; unknown scores last.

    Scores are compared by eight decimals: engines and partitionings differ in
    the bits beyond, and the order must not.
    """
    r8 = lambda c: F.round(c, 8)
    worst = F.lit(float("inf"))
    return [F.coalesce(-r8("mean_ba"), worst), F.coalesce(r8("std_ba"), worst), F.coalesce(r8("mean_log_loss"), worst), F.col("complexity"), F.col("simplicity"), F.col("candidate")]


def ranked(candidates: DataFrame) -> DataFrame:
    """:func:`summary` with ``rank``: no two of a ticker are equal."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy(*_order())).cast("long"))


def edge_gate(suite: DataFrame, models: Sequence[str], baselines: Sequence[str], config: GateConfig = GateConfig(), standings: Mapping[str, Standing] = {}) -> DataFrame:
    """The first of ``models`` by rank against the best of ``baselines``, one row a ticker of the suite.

    Name one model to gate that one.  Of baselines of equal means the one named
    first counts; fold wins are strict and against it alone.  Without a
    baseline (or a model) there is no edge and no margin.  Two aggregations: a
    candidate's folds, which are few, travel as a map.
    """
    s = summary(suite.where(F.col("candidate").isin([*models, *baselines])), standings)
    place = _by_name({b: F.lit(i) for i, b in enumerate(baselines)}, F.lit(len(baselines)))
    one = F.struct("candidate", "mean_ba", "mean_auc", "mean_mcc", "folds")
    best_model = F.min_by(F.when(F.col("candidate").isin(list(models)), one), F.when(F.col("candidate").isin(list(models)), F.struct(*_order())))
    is_base = F.col("candidate").isin(list(baselines))
    best_base = F.min_by(F.when(is_base, one), F.when(is_base, F.struct(F.coalesce(-F.round("mean_ba", 8), F.lit(float("inf"))), place)))
    g = s.groupBy("ticker").agg(best_model.alias("m"), best_base.alias("b"))
    wins = F.expr("size(filter(map_keys(m.folds), f -> m.folds[f] > b.folds[f]))")
    g = g.select(
        "ticker",
        F.col("m.candidate").alias("model"),
        F.col("m.mean_ba").alias("model_ba"),
        F.col("m.mean_auc").alias("mean_auc"),
        F.col("m.mean_mcc").alias("mean_mcc"),
        F.col("b.candidate").alias("baseline"),
        F.col("b.mean_ba").alias("baseline_ba"),
        F.when(F.col("m").isNotNull() & F.col("b").isNotNull(), wins).otherwise(0).cast("long").alias("fold_wins"),
        (F.col("m.mean_ba") - F.col("b.mean_ba")).alias("margin"),
    )
    passed = {
        "margin_ok": F.round("margin", 8) >= config.margin,
        "wins_ok": F.col("baseline").isNotNull() & (F.col("fold_wins") >= config.fold_wins),
        "auc_ok": F.col("mean_auc") > config.least_auc,
        "mcc_ok": F.col("mean_mcc") > config.least_mcc,
    }
    g = g.withColumns({name: F.coalesce(test, F.lit(False)) for name, test in passed.items()})
    return g.withColumn("edge", F.col("margin_ok") & F.col("wins_ok") & F.col("auc_ok") & F.col("mcc_ok"))


def gate_reason(gate: Mapping) -> str:
    """The gate's row in words."""
    if gate["baseline"] is None:
        return "no baselines evaluated, so no edge can be established"
    failed = [name.removesuffix("_ok") for name in ("margin_ok", "wins_ok", "auc_ok", "mcc_ok") if not gate[name]]
    verdict = f"no stable edge ({', '.join(failed)} not met)" if failed else "edge"
    return f"{verdict}: {gate['model']} scored {gate['model_ba']:.4f} against {gate['baseline_ba']:.4f} of {gate['baseline']}, {gate['fold_wins']} folds won"


def top_absolute(values: DataFrame, n: int = 20) -> DataFrame:
    """The n rows of ``name, value`` that are largest in absolute value."""
    return values.orderBy(F.desc(F.abs("value")), "name").limit(n)
