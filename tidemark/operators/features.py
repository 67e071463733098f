"""Causal window features: nothing looks past its own session.

Every family is a list of expressions over one window spec, so Catalyst plans
one shuffle by ticker and one Window node for each frame length.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import by_session, finite, full, ratio, trailing
from ..functions.ranks import in_cells
from ..functions.shared import Scratch
from .quality import assert_no_leakage

FEATURE_VERSION = "v1"


#: Rows of a cell of a long ticker.
CELL_ROWS = 100_000


@dataclass(frozen=True)
class FeatureConfig:
    """Window lengths in sessions."""

    returns: tuple[int, ...] = (1, 2, 3, 5, 10, 20)
    momentum: tuple[int, ...] = (5, 10, 20)
    up_days: tuple[int, ...] = (5, 10)
    averages: tuple[int, ...] = (5, 10, 20, 50)
    volatility: tuple[int, ...] = (5, 10, 20)
    volume: int = 20
    relative: tuple[int, ...] = (1, 5)
    rolling: int = 20
    benchmark: bool = False

    def warm_up(self) -> int:
        """Sessions before a full row: the longest window, one more where it runs over returns."""
        spans = [*self.returns, *self.momentum, *(n + 1 for n in self.up_days), *self.averages, *(n + 1 for n in self.volatility), self.volume + 1]
        return max(spans + ([*self.relative, self.rolling + 1] if self.benchmark else []))


def lagged(column: str, n: int) -> Column:
    return F.lag(column, n).over(by_session())


def with_return(panel: DataFrame) -> DataFrame:
    """The panel with ``ret``, the close-to-close return that several families share."""
    return panel.withColumn("ret", ratio("close", lagged("close", 1)) - 1)


def lagged_returns(windows: tuple[int, ...]) -> dict[str, Column]:
    return {f"return_{n}d": ratio("close", lagged("close", n)) - 1 for n in windows}


def skip_momentum(windows: tuple[int, ...]) -> dict[str, Column]:
    """Return up to yesterday: the last session is left out."""
    return {f"momentum_{n}d": ratio(lagged("close", 1), lagged("close", n)) - 1 for n in windows}


def up_day_share(windows: tuple[int, ...]) -> dict[str, Column]:
    up = F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))
    return {f"positive_days_last_{n}": full(n, up, F.sum(up).over(trailing(n)) / n) for n in windows}


def average_ratios(windows: tuple[int, ...]) -> dict[str, Column]:
    """Close against its averages, and each average against the next longer one."""
    mean = {n: full(n, F.col("close"), F.avg("close").over(trailing(n))) for n in sorted(windows)}
    out = {f"close_to_sma_{n}": ratio(F.col("close"), mean[n]) - 1 for n in windows}
    lengths = sorted(windows)
    return out | {f"sma_{a}_to_sma_{b}": ratio(mean[a], mean[b]) - 1 for a, b in zip(lengths, lengths[1:])}


def volatility(windows: tuple[int, ...]) -> dict[str, Column]:
    deviation = {n: full(n, F.col("ret"), F.stddev_samp("ret").over(trailing(n))) for n in windows}
    out = {f"volatility_{n}d": deviation[n] for n in windows}
    if len(windows) > 1:
        a, b = min(windows), max(windows)
        out[f"vol_ratio_{a}d_{b}d"] = ratio(deviation[a], deviation[b]) - 1
    return out


def bar_shape() -> dict[str, Column]:
    """Range, gap and place within the range; a bar without a range has the middle."""
    span = F.col("high") - F.col("low")
    return {
        "intraday_range": ratio(span, F.col("close")),
        "overnight_gap": ratio(F.col("open"), lagged("close", 1)) - 1,
        "open_to_close_return": ratio("close", "open") - 1,
        "close_position_in_range": F.when(span > 1e-12, (F.col("close") - F.col("low")) / span).otherwise(0.5),
    }


def volume_relative(n: int) -> dict[str, Column]:
    mean = full(n, F.col("volume"), F.avg("volume").over(trailing(n)))
    deviation = full(n, F.col("volume"), F.stddev_samp("volume").over(trailing(n)))
    return {
        "volume_change_1d": ratio("volume", lagged("volume", 1)) - 1,
        f"volume_to_sma_{n}": ratio(F.col("volume"), mean) - 1,
        f"volume_zscore_{n}": ratio(F.col("volume") - mean, deviation),
    }


def benchmark_relative(relative: tuple[int, ...], n: int) -> dict[str, Column]:
    """Against ``bench_close`` and its return ``bench_ret`` (see :func:`with_benchmark_return`)."""
    w = trailing(n)
    both = F.when(F.col("ret").isNotNull() & F.col("bench_ret").isNotNull(), F.lit(1))
    covariance = F.covar_samp("ret", "bench_ret").over(w)
    out = {"benchmark_return_1d": F.col("bench_ret")}
    out |= {f"relative_return_{k}d": ratio("close", lagged("close", k)) - ratio("bench_close", lagged("bench_close", k)) for k in relative}
    out[f"rolling_beta_{n}"] = full(n, both, ratio(covariance, F.var_samp("bench_ret").over(w)))
    # not corr(): it fails on a constant frame
    out[f"rolling_correlation_{n}"] = full(n, both, ratio(covariance, F.stddev_samp("ret").over(w) * F.stddev_samp("bench_ret").over(w)))
    return out


def with_benchmark_return(panel: DataFrame) -> DataFrame:
    return with_return(panel).withColumn("bench_ret", ratio("bench_close", lagged("bench_close", 1)) - 1)


def feature_columns(config: FeatureConfig = FeatureConfig()) -> dict[str, Column]:
    """All features by name, in the order of the manifest."""
    out: dict[str, Column] = {}
    families = [
        lagged_returns(config.returns),
        skip_momentum(config.momentum),
        up_day_share(config.up_days),
        average_ratios(config.averages),
        volatility(config.volatility),
        bar_shape(),
        volume_relative(config.volume),
        *([benchmark_relative(config.relative, config.rolling)] if config.benchmark else []),
    ]
    for family in families:
        if repeated := out.keys() & family.keys():
            raise ValueError(f"feature names repeat: {sorted(repeated)}")
        out |= family
    return out


def build_features(panel: DataFrame, config: FeatureConfig = FeatureConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``ticker, session``, the columns of ``keep`` and all features; not-finite values are null."""
    base = with_benchmark_return(panel) if config.benchmark else with_return(panel)
    names = feature_columns(config)
    assert_no_leakage(list(names))
    return base.select("ticker", "session", *keep, *[finite(c).alias(n) for n, c in names.items()])


def build_features_in_cells(panel: DataFrame, scratch: Scratch, config: FeatureConfig = FeatureConfig(), cell_rows: int = CELL_ROWS) -> DataFrame:
    """:func:`build_features` for tickers with more rows than a task should sort: the same features from cells with a halo.

    No feature looks further back than ``warm_up`` rows, so a cell with as many
    rows before it gives the same values as the whole ticker.
    """
    cells = in_cells(panel, "ticker", ["session"], config.warm_up(), cell_rows, scratch)
    found = build_features(cells, config, ("_key", "_halo")).where(~F.col("_halo"))
    return found.withColumn("ticker", F.col("_key")).drop("_key", "_halo")


def manifest(config: FeatureConfig = FeatureConfig()) -> dict:
    """What a model must be given: names in order, version, windows and warm-up."""
    return {"version": FEATURE_VERSION, "features": list(feature_columns(config)), "config": asdict(config), "max_window": config.warm_up()}


def in_manifest_order(frame: DataFrame, names: list[str]) -> DataFrame:
    """The frame's features as a model expects them; a missing one is an error."""
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"features missing: {missing}")
    return frame.select("ticker", "session", *names)
