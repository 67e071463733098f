"""Every query of the panel engine: operators bound to the driver's tables.

Sessions leave as text and floats rounded, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import iso, rounded
from ..functions import ranks as rks
from ..functions.shared import Scratch, materialize
from ..operators import backtest as bt
from ..operators import baselines as bl
from ..operators import benchmark as bm
from ..operators import bootstrap as bs
from ..operators import calibration as cal
from ..operators import features as ft
from ..operators import folds as fo
from ..operators import labels as lb
from ..operators import logistic as lg
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import quality as ql
from ..operators import ranking as rk
from ..operators import trees as tr
from ..operators.blocks import packed
from ..sources import panels

Query = Callable[[SparkSession, str], DataFrame]
ASSET, BENCHMARK = "F", "O"
PAIR = ("candidate", "ticker")
SHORT_RUN = bt.BacktestConfig(threshold=0.5, allow_short=True, short_threshold=0.45)
CLOSE_RUN = bt.BacktestConfig(mode="close_to_close", threshold=0.5)
SAMPLES, BLOCK, SEED = 2000, 20, 42
LOGISTIC = md.Candidate("logistic", {"C": 1.0, "balanced": True})
#: What the ranking knows of the rule candidates besides their scores.
STANDINGS = {"reversion": rk.Standing(1, (20.0,)), "always_up": rk.Standing(0, (1.0,)), "majority_class": rk.Standing(0, (0.0,))}


def _out(df: DataFrame) -> DataFrame:
    """Sessions as text, counts as long, floats rounded."""
    columns: list[Column] = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        columns.append((F.date_format(c, "yyyy-MM-dd") if kind == "date" else F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else rounded(c) if kind == "double" else c.cast("long") if kind == "integer" else c).alias(f.name))
    return df.select(*columns)


# ---- panels and quality ----


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _out(panels.daily(spark, sf))


def bars_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _out(panels.daily(spark, sf, "l_suppkey"))


def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return _out(panels.hourly(spark, sf))


def order_flow(spark: SparkSession, sf: str) -> DataFrame:
    return _out(panels.order_flow(spark, sf))


def normalized_bars(spark: SparkSession, sf: str) -> DataFrame:
    p = panels.daily(spark, sf)
    raw = p.select("ticker", F.concat(iso(), F.lit("T00:00:00-05:00")).alias("Date"), *[F.when(F.dayofmonth("session") == 3, F.lit("n/a")).otherwise(F.col(c).cast("string")).alias(c.title()) for c in panels.BAR_COLUMNS])
    return _out(panels.normalize(raw))


def _with_repeats(p: DataFrame) -> DataFrame:
    return p.unionByName(p.where(F.dayofmonth("session") == 15))


def _with_conflicts(p: DataFrame) -> DataFrame:
    return p.unionByName(p.where(F.dayofmonth("session") == 10).withColumn("close", F.col("close") + 1.0))


def _with_defects(p: DataFrame) -> DataFrame:
    """Highs below everything on the 7th, lows above everything on the 8th, no volume on the 9th."""
    day = F.dayofmonth("session")
    return p.select(
        "ticker", "session", "open",
        F.when(day == 7, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(day == 8, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
        "close",
        F.when(day == 9, 0.0).otherwise(F.col("volume")).alias("volume"),
    )


def bar_dedup(spark: SparkSession, sf: str) -> DataFrame:
    p = _with_repeats(panels.daily(spark, sf))
    kept = p.dropDuplicates(["ticker", "session"])
    return kept.groupBy("ticker").agg(F.count("*").alias("n_rows")).join(p.groupBy("ticker").agg(F.count("*").alias("n_before")), "ticker").select("ticker", "n_rows", (F.col("n_before") - F.col("n_rows")).alias("n_removed"))


def bar_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ql.conflicts(_with_conflicts(_with_repeats(panels.daily(spark, sf)))))


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ql.quality_report(_with_defects(panels.daily(spark, sf)), 0.04))


def large_moves(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ql.large_moves(panels.daily(spark, sf), 0.04).select("ticker", "session", "move"))


def calendar_gaps(spark: SparkSession, sf: str) -> DataFrame:
    some = panels.daily(spark, sf).where(~F.dayofmonth("session").between(3, 15))
    return _out(ql.gaps(some, 10).select("ticker", "session", "gap_days"))


def ohlc_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ql.violations(_with_defects(panels.daily(spark, sf))))


def quality_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ql.first_sessions(_with_defects(panels.daily(spark, sf)), 0.04)


def bar_describe(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ql.describe(panels.daily(spark, sf), list(panels.BAR_COLUMNS)))


def open_session_drop(spark: SparkSession, sf: str) -> DataFrame:
    p = ql.drop_open_session(panels.daily(spark, sf), "1996-07-01")
    return _out(p.groupBy("ticker").agg(F.max("session").alias("last_session"), F.count("*").alias("n_rows")))


# ---- features ----


def _family(columns: Callable[[], dict[str, Column]]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        p = ft.with_return(panels.daily(spark, sf))
        return _out(p.select("ticker", "session", *[c.alias(n) for n, c in columns().items()]))

    return query


D = ft.FeatureConfig()


def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ft.build_features(panels.daily(spark, sf)).dropna())


def feature_matrix_in_cells(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`feature_matrix` from cells of 120 rows with a halo, as long tickers are taken."""
    with Scratch(spark, "cells") as scratch:
        found = ft.build_features_in_cells(panels.daily(spark, sf), scratch, cell_rows=120)
        return _out(scratch.write(found, "features", keep=True).dropna())


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    asset, bench = bm.split_benchmark(panels.daily(spark, sf), ASSET, BENCHMARK)
    return bm.align(asset, bench)


def _benchmark_family(prefixes: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        p = ft.with_benchmark_return(_aligned(spark, sf))
        chosen = {n: c for n, c in ft.benchmark_relative(D.relative, D.rolling).items() if n.startswith(prefixes)}
        return _out(p.select("ticker", "session", *[c.alias(n) for n, c in chosen.items()]))

    return query


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    asset, bench = bm.split_benchmark(panels.daily(spark, sf), ASSET, BENCHMARK)
    return asset, bench.where(F.dayofmonth("session") != 20)


def benchmark_align(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bm.alignment_audit(*_split(spark, sf)))


def benchmark_lost_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bm.lost_sessions(*_split(spark, sf)))


def benchmark_feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _out(ft.build_features(_aligned(spark, sf), ft.FeatureConfig(benchmark=True)).dropna())


def asof_signal(spark: SparkSession, sf: str) -> DataFrame:
    p = panels.daily(spark, sf).where(F.dayofmonth("session") % 3 == 0)
    moments = panels.table(spark, sf, "orders").select(F.lit(ASSET).alias("ticker"), F.to_date("o_orderdate").alias("moment")).distinct()
    return _out(bm.last_at_or_before(p, moments))


def next_session(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bm.next_sessions(panels.daily(spark, sf)))


# ---- labels and dataset ----


def label_c2c(spark: SparkSession, sf: str) -> DataFrame:
    p = lb.with_labels(panels.daily(spark, sf), lb.LabelConfig("close_to_close", 3))
    return _out(p.select("ticker", "session", "future_return", "target"))


def label_o2c(spark: SparkSession, sf: str) -> DataFrame:
    return _out(lb.with_labels(panels.daily(spark, sf)).select("ticker", "session", "future_return", "target"))


def unlabeled_tail(spark: SparkSession, sf: str) -> DataFrame:
    p = lb.drop_unlabeled_tail(panels.daily(spark, sf), 3)
    return _out(p.groupBy("ticker").agg(F.max("session").alias("last_session"), F.count("*").alias("n_rows")))


def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _out(lb.label_summary(lb.with_labels(panels.daily(spark, sf))))


def _dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled rows, written: they feed every fold and candidate, and a written table is a leaf to the optimizer."""
    return materialize(lb.build_dataset(panels.daily(spark, sf)), "dataset")


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_dataset(spark, sf).select("ticker", "session", "row_idx", "n_rows", "future_return", "target", "return_1d", "close_to_sma_50", "volatility_20d", "volume_zscore_20"))


def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _out(lb.dataset_summary(_dataset(spark, sf)))


# ---- folds ----


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _dataset(spark, sf).groupBy("ticker").agg(F.count("*").alias("n_rows"))


def dev_test_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _out(fo.bounds(_sizes(spark, sf)))


def holdout_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return _out(fo.holdout(_sizes(spark, sf)))


def fold_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return _out(fo.development_folds(_dataset(spark, sf)))


def fold_causality(spark: SparkSession, sf: str) -> DataFrame:
    """The development folds, and the same with eval parts moved two rows forward in time: which of them look ahead."""
    folds = fo.development_folds(_dataset(spark, sf)).select("ticker", "fold", "train_end", "eval_start", "eval_end")
    early = folds.withColumn("eval_start", F.col("eval_start") - 2)
    named = lambda df, name: fo.causality(df, 1).select(F.lit(name).alias("folds"), "ticker", "fold", "after_train", "in_order", "filled")
    return _out(named(folds, "development").unionByName(named(early, "early")))


def holdout_causality(spark: SparkSession, sf: str) -> DataFrame:
    """Train, validation and test part: whether each follows the one before by the gap of one row, and by one of two."""
    parts = fo.holdout(_sizes(spark, sf))
    named = lambda gap: fo.holdout_causality(parts, gap).select(F.lit(gap).cast("long").alias("gap"), "ticker", "part", "follows", "filled")
    return _out(named(1).unionByName(named(2)))


def fold_membership(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dataset(spark, sf)
    return _out(fo.fold_rows(rows, fo.development_folds(rows), "eval").select("ticker", "fold", "row_idx", "session"))


def holdout_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _out(fo.holdout_spans(_dataset(spark, sf)))


def fold_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dataset(spark, sf)
    return _out(fo.fold_spans(rows, fo.development_folds(rows)))


# ---- baselines and metrics ----


def _scored(spark: SparkSession, sf: str, with_rule: bool = True) -> DataFrame:
    rows = _dataset(spark, sf)
    folds = fo.development_folds(rows)
    out = bl.baseline_oof(rows, folds)
    return materialize(out.unionByName(bl.reversion_oof(rows, folds)) if with_rule else out, "scored")


def _baseline(name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _out(_scored(spark, sf, False).where(F.col("candidate") == name).select("ticker", "fold", "row_idx", "proba_up", "prediction"))

    return query


def oof_union(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_scored(spark, sf).groupBy("candidate", "ticker", "fold").agg(F.count("*").alias("n"), F.avg("proba_up").alias("mean_proba"), F.sum("prediction").alias("n_up")))


def metric_suite(spark: SparkSession, sf: str) -> DataFrame:
    return _out(mt.metric_suite(_scored(spark, sf)))


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _out(mt.rank_metrics(_scored(spark, sf)).select(*mt.KEYS, "roc_auc"))


def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    return _out(mt.rank_metrics(_scored(spark, sf)).select(*mt.KEYS, "pr_auc"))


def rank_metrics_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Rank metrics of order lines as scores of their status: nearly as many distinct scores as rows, taken in ranges."""
    score = F.col("l_extendedprice") / F.col("l_quantity") + F.col("l_discount")
    lines = panels.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("candidate"), score.alias("proba_up"), (F.col("l_linestatus") == "F").cast("int").alias("target"))
    with Scratch(spark, "ranges") as scratch:
        return _out(scratch.write(mt.rank_metrics(lines, ("candidate",), scratch), "ranks", keep=True))


def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return _out(mt.roc_points(_scored(spark, sf), PAIR))


def pr_points(spark: SparkSession, sf: str) -> DataFrame:
    return _out(mt.pr_points(_scored(spark, sf), PAIR))


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _out(mt.confusion(_scored(spark, sf), PAIR))


def fold_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return _out(mt.fold_aggregate(mt.metric_suite(_scored(spark, sf))))


def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    """By year, and of all years (year 0), in one aggregation."""
    years = F.explode(F.array(F.year("session"), F.lit(0))).alias("year")
    each = _dataset(spark, sf).select("ticker", years, "target").groupBy("ticker", "year")
    return _out(each.agg(F.count("*").alias("n"), F.avg("target").alias("up_rate")))


# ---- calibration ----


def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cal.calibration_bins(_scored(spark, sf), PAIR))


def ece_mce(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cal.calibration_errors(_scored(spark, sf), PAIR))


def calibration_report(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cal.calibration_report(_scored(spark, sf), PAIR))


def probability_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cal.histogram(_scored(spark, sf), PAIR))


def threshold_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cal.threshold_scan(_scored(spark, sf), PAIR))


def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cal.best_threshold(cal.threshold_scan(_scored(spark, sf), PAIR), PAIR))


def net_sharpe_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _out(cal.net_sharpe_scan(_scored(spark, sf).where("candidate = 'reversion'"), PAIR, 0.001))


# ---- backtest ----


def _days(config: bt.BacktestConfig) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        rule = _scored(spark, sf).where("candidate in ('reversion', 'last_direction')")
        return materialize(bt.daily(bt.strategies(rule, config), config), "days")

    return build


def positions(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_days(SHORT_RUN)(spark, sf).select("strategy", "ticker", "session", "position"))


def cost_intraday(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_days(SHORT_RUN)(spark, sf).select("strategy", "ticker", "session", "cost"))


def cost_c2c(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_days(CLOSE_RUN)(spark, sf).select("strategy", "ticker", "session", "cost"))


def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_days(SHORT_RUN)(spark, sf).select("strategy", "ticker", "session", "net_return", F.ln("equity").alias("log_equity")))


def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_days(SHORT_RUN)(spark, sf).select("strategy", "ticker", "session", "drawdown"))


def curve_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Equity and drawdown by scans over ranges of the sessions."""
    with Scratch(spark, "curve") as scratch:
        found = scratch.write(bt.curve_in_ranges(_days(SHORT_RUN)(spark, sf), scratch), "curve", keep=True)
    return _out(found.select("strategy", "ticker", "session", F.ln("equity").alias("log_equity"), "drawdown"))


def trades_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bt.trades(_days(CLOSE_RUN)(spark, sf), CLOSE_RUN))


def trades_intraday(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bt.trades(_days(SHORT_RUN)(spark, sf), SHORT_RUN))


def backtest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bt.economic_metrics(_days(SHORT_RUN)(spark, sf), SHORT_RUN))


def backtest_compare(spark: SparkSession, sf: str) -> DataFrame:
    m = bt.economic_metrics(_days(CLOSE_RUN)(spark, sf), CLOSE_RUN)
    return _out(m.select("strategy", "ticker", "cumulative_return", "sharpe", "max_drawdown", "n_trades", "total_cost", "profit_factor"))


def buy_and_hold(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dataset(spark, sf)
    d = bt.daily(bt.buy_and_hold(panels.daily(spark, sf), rows), CLOSE_RUN)
    return _out(d.select("ticker", "session", "net_return", "cost", F.ln("equity").alias("log_equity")))


# ---- bootstrap ----


def _series(spark: SparkSession, sf: str) -> DataFrame:
    d = _days(SHORT_RUN)(spark, sf).where(F.col("strategy") == "reversion")
    return d.select(F.col("ticker").alias("key"), "session", F.col("net_return").alias("value"))


def _numbered(series: DataFrame) -> DataFrame:
    idx = (F.row_number().over(Window.partitionBy("key").orderBy("session")) - 1).cast("long")
    return series.select("key", idx.alias("idx"), "value")


def block_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return _out(bs.block_bootstrap(_numbered(_series(spark, sf)), SAMPLES, BLOCK))


def block_bootstrap_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`block_bootstrap` as it is taken of series that no task could hold."""
    with Scratch(spark, "bootstrap") as scratch:
        found = bs.block_bootstrap(_numbered(_series(spark, sf)), SAMPLES, BLOCK, scratch=scratch)
        return _out(scratch.write(found, "bootstrap", keep=True))


def bootstrap_difference(spark: SparkSession, sf: str) -> DataFrame:
    d = _days(SHORT_RUN)(spark, sf)
    of = lambda s: d.where(F.col("strategy") == s).select(F.col("ticker").alias("key"), "session", F.col("net_return").alias("value"))
    return _out(bs.bootstrap_difference(of("reversion"), of("always_active"), n_samples=SAMPLES, block=BLOCK))


# ---- ranking ----


def candidate_rank(spark: SparkSession, sf: str) -> DataFrame:
    suite = mt.metric_suite(_scored(spark, sf))
    return _out(rk.ranked(rk.summary(suite, STANDINGS)).drop("folds", "simplicity"))


def edge_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _out(rk.edge_gate(mt.metric_suite(_scored(spark, sf)), ["reversion"], bl.BASELINES))


# ---- models ----


def _model(candidate: md.Candidate) -> Query:
    """Out-of-fold scores of one setting on every ticker, with the small feature set."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = _dataset(spark, sf)
        return _out(md.model_oof(rows, fo.development_folds(rows), [candidate], list(ft.feature_columns())).drop("future_return"))

    return query


def _train_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _dataset(spark, sf)
    return rows, fo.development_folds(rows)


def train_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Exact medians of every feature in every train part, by selection of ranks."""
    rows, folds = _train_parts(spark, sf)
    names = list(ft.feature_columns())
    train = fo.fold_rows(rows, folds, "train").select("ticker", "fold", "row_idx", F.posexplode(F.array(*names)).alias("j", "value"))
    with Scratch(spark, "medians") as scratch:
        found = scratch.write(rks.medians(train, ["ticker", "fold", "j"], "value", "row_idx", scratch), "medians", keep=True)
    return _out(found.select("ticker", "fold", F.array(*map(F.lit, names))[F.col("j")].alias("feature"), "median"))


def feature_bins(spark: SparkSession, sf: str) -> DataFrame:
    """The bin edges of every feature in every train part: how many, the least, the largest and their sum."""
    rows, folds = _train_parts(spark, sf)
    names = list(ft.feature_columns())
    rows = rows.withColumns({n: rounded(F.col(n)) for n in names})
    with Scratch(spark, "bins") as scratch:
        found = scratch.write(tr.edges(rows, folds, names, scratch).select("ticker", "fold", F.posexplode("edges").alias("j", "e")), "bins", keep=True)
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return _out(found.select("ticker", "fold", F.array(*map(F.lit, names))[F.col("j")].alias("feature"), F.size("e").alias("n_edges"), F.array_min("e").alias("least"), F.array_max("e").alias("most"), total.alias("total")))


def permuted_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature dealt anew five times over each ticker's development rows: its product with the target and with the row's place."""
    names = list(ft.feature_columns())
    with Scratch(spark, "dealt") as scratch:
        dealt = md.permuted_rows(_development(spark, sf), ["ticker"], names, 5, SEED, scratch)
        value = F.expr("x[j]")
        sums = dealt.groupBy("ticker", "j", "repeat").agg(F.sum(value * F.col("target")).alias("with_target"), F.sum(value * F.col("row_idx")).alias("with_place"), F.count("*").alias("n"))
        sums = scratch.write(sums, "sums", keep=True)
    return _out(sums.select("ticker", F.array(*map(F.lit, names))[F.col("j")].alias("feature"), "repeat", "n", "with_target", (F.col("with_place") / F.col("n")).alias("with_place")))


def logistic_stationarity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the slope of the penalised loss is zero at the coefficients fitted on each train part."""
    rows, folds = _train_parts(spark, sf)
    names = list(ft.feature_columns())
    with Scratch(spark, "stationary") as scratch:
        parts = lg.prepared(rows, folds, names, scratch)
        ends = folds.groupBy("ticker").agg(F.max("train_end").alias("_last"))
        blocks = scratch.write(packed(rows.join(fo.small(ends), "ticker").where("row_idx < _last"), names), "blocks")
        models = lg.fitted(blocks, parts, [("logistic", 1.0, True)], scratch)
        found = scratch.write(lg.slopes(rows, parts, models, 1.0, True, names), "slopes", keep=True)
    return _out(found.select("ticker", "fold", "n", (F.col("slope") < 1e-6).alias("flat")))


def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 largest coefficients of a logistic model of each ticker's development part; the holdout stays sealed."""
    found = md.importance(LOGISTIC, _development(spark, sf), list(ft.feature_columns()))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(F.abs("value")), "name"))
    return _out(found.withColumn("place", place).where("place <= 20").drop("place"))


def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of balanced accuracy of that model when a feature is dealt anew, five times each."""
    return _out(md.importance(LOGISTIC, _development(spark, sf), list(ft.feature_columns()), repeats=5))


def _development(spark: SparkSession, sf: str) -> DataFrame:
    """The rows before the holdout."""
    rows = _dataset(spark, sf)
    ends = fo.bounds(rows.groupBy("ticker").agg(F.count("*").alias("n_rows"))).select("ticker", "dev_end")
    return rows.join(fo.small(ends), "ticker").where(F.col("row_idx") < F.col("dev_end"))


def lookback_sequences(spark: SparkSession, sf: str) -> DataFrame:
    s = md.sequences(_dataset(spark, sf), ["return_1d", "intraday_range"], 5)
    return _out(s.select("ticker", "session", F.size("sequence").alias("length"), F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x).alias("total")))


# ---- exploratory statistics ----


def overnight_variance(spark: SparkSession, sf: str) -> DataFrame:
    p = panels.daily(spark, sf)
    shape = ft.bar_shape()
    r = p.select("ticker", shape["overnight_gap"].alias("night"), shape["open_to_close_return"].alias("day"))
    a = r.where("night is not null").groupBy("ticker").agg(F.var_samp("night").alias("vn"), F.var_samp("day").alias("vd"))
    return _out(a.select("ticker", (F.col("vn") / (F.col("vn") + F.col("vd"))).alias("overnight_share")))


def lag_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    lags = (1, 2, 3, 5, 10)
    p = ft.with_return(panels.daily(spark, sf))
    p = p.select("ticker", "ret", *[ft.lagged("ret", k).alias(f"_{k}") for k in lags])
    each = p.select("ticker", "ret", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"_{k}").alias("before")) for k in lags])).alias("x")).select("ticker", "ret", "x.*")
    both = each.where("ret is not null and before is not null").groupBy("ticker", "lag")
    c = both.agg(F.covar_samp("ret", "before").alias("c"), (F.stddev_samp("ret") * F.stddev_samp("before")).alias("s"))
    return _out(c.select("ticker", "lag", F.try_divide("c", "s").alias("autocorrelation")))


def feature_target_correlation(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dataset(spark, sf)
    names = list(ft.feature_columns())
    each = rows.select("ticker", F.col("target").cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names])).alias("f")).select("ticker", "y", "f.*")
    c = each.groupBy("ticker", "feature").agg(F.covar_samp("x", "y").alias("c"), (F.stddev_samp("x") * F.stddev_samp("y")).alias("s"))
    return _out(c.select("ticker", "feature", F.try_divide("c", "s").alias("correlation")))


def feature_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature with every other, as places in an array of all features: the plan does not grow with their number."""
    names = list(ft.feature_columns())
    last = len(names) - 1
    rows = _dataset(spark, sf).select("ticker", F.array(*names).alias("x"))
    pairs = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(last - 1)))).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(last))))
    each = pairs.select("ticker", "i", "j", F.col("x")[F.col("i")].alias("a"), F.col("x")[F.col("j")].alias("b")).groupBy("ticker", "i", "j")
    c = each.agg(F.covar_samp("a", "b").alias("c"), (F.stddev_samp("a") * F.stddev_samp("b")).alias("s"))
    named = F.array(*map(F.lit, names))
    return _out(c.select("ticker", named[F.col("i")].alias("feature"), named[F.col("j")].alias("other"), F.try_divide("c", "s").alias("correlation")))


def rolling_feature_correlation(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.numeric import trailing

    rows = _dataset(spark, sf).withColumn("y", F.col("target").cast("double"))
    w = trailing(252)
    r = F.try_divide(F.covar_samp("return_1d", "y").over(w), F.stddev_samp("return_1d").over(w) * F.stddev_samp("y").over(w))
    return _out(rows.select("ticker", "session", F.when(F.count("*").over(w) == 252, r).alias("correlation")))


def hourly_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: events to bars, features, labels, last-direction positions and their backtest by event type."""
    small = ft.FeatureConfig(returns=(1, 5), momentum=(5,), up_days=(5,), averages=(5, 10), volatility=(5,), volume=10)
    rows = lb.build_dataset(panels.hourly(spark, sf), small)
    held = rows.select(F.lit("last_direction").alias("strategy"), "ticker", "session", (F.col("open_to_close_return") > 0).cast("double").alias("position"), "future_return")
    d = bt.daily(held)
    m = d.groupBy("ticker").agg(F.count("*").alias("n"), (F.max_by("equity", "session") - 1).alias("cumulative_return"), F.avg("position").alias("exposure"), F.min("drawdown").alias("max_drawdown"))
    return _out(m)


def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars as the stream gives them; equal to ``bars_hourly``."""
    from ..streaming.bars import replay_events

    return _out(replay_events(spark, sf))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        bars_daily, bars_wide, bars_hourly, order_flow, normalized_bars, bar_dedup, bar_conflicts, quality_report, quality_sessions, bar_describe, large_moves, calendar_gaps, ohlc_violations, open_session_drop,
        feature_matrix, feature_matrix_in_cells, benchmark_align, benchmark_lost_sessions, benchmark_feature_matrix, asof_signal, next_session,
        label_c2c, label_o2c, unlabeled_tail, label_summary, dataset, dataset_summary,
        dev_test_bounds, holdout_ranges, holdout_spans, holdout_causality, fold_ranges, fold_causality, fold_membership, fold_spans,
        oof_union, metric_suite, roc_auc, avg_precision, rank_metrics_in_ranges, roc_points, pr_points, confusion, fold_aggregate, class_balance,
        calibration_bins, ece_mce, calibration_report, probability_histogram, threshold_scan, best_threshold, net_sharpe_scan,
        positions, cost_intraday, cost_c2c, equity_curve, drawdown, curve_in_ranges, trades_blocks, trades_intraday, backtest_metrics, backtest_compare, buy_and_hold,
        block_bootstrap, block_bootstrap_in_ranges, bootstrap_difference, candidate_rank, edge_gate, train_medians, feature_bins, permuted_features, logistic_stationarity, feature_importance, permutation_importance, lookback_sequences,
        overnight_variance, lag_autocorrelation, feature_target_correlation, feature_correlation, rolling_feature_correlation, hourly_strategy, stream_bars,
    )
}
QUERIES |= {
    "lagged_returns": _family(lambda: ft.lagged_returns(D.returns)),
    "skip_momentum": _family(lambda: ft.skip_momentum(D.momentum)),
    "up_day_share": _family(lambda: ft.up_day_share(D.up_days)),
    "sma_ratios": _family(lambda: ft.average_ratios(D.averages)),
    "rolling_volatility": _family(lambda: ft.volatility(D.volatility)),
    "bar_shape": _family(ft.bar_shape),
    "volume_relative": _family(lambda: ft.volume_relative(D.volume)),
    "relative_returns": _benchmark_family(("benchmark_return", "relative_return")),
    "rolling_beta": _benchmark_family(("rolling_beta",)),
    "rolling_correlation": _benchmark_family(("rolling_correlation",)),
    **{f"baseline_{n}": _baseline(n) for n in bl.BASELINES},
    "logistic_oof": _model(LOGISTIC),
    "gradient_boosting_oof": _model(md.Candidate("gradient_boosting", {"rate": 0.1, "leaves": 7})),
    "random_forest_oof": _model(md.Candidate("random_forest", {"trees": 400, "depth": 6, "least": 30})),
}
