"""Moving-block bootstrap of return series.

A resample's statistics are sums over its blocks, and a block's sums are two
lookups in running sums, so no resample is ever spelled out: work is draws x
blocks, not draws x rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.ranks import running
from ..functions.shared import Scratch


def block_starts(sizes: DataFrame, n_samples: int, block: int, seed: int) -> DataFrame:
    """``key, sample, block_no, start`` for series of ``key, n`` rows: starts uniform over the places of a whole block.

    Drawn from a hash of seed, sample and block, so any engine and any
    partitioning draws the same.
    """
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.col("n")))
    s = sizes.select("key", "n", length.alias("length"), F.ceil(F.col("n") / length).alias("blocks"))
    s = s.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).withColumn("block_no", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string"), F.col("block_no").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return s.select("key", "n", "length", "sample", "block_no", F.floor(draw * (F.col("n") - F.col("length") + 1)).cast("long").alias("start"))


def resampled(series: DataFrame, n_samples: int = 2000, block: int = 20, seed: int = 42) -> DataFrame:
    """``key, sample, place, value``: each resample of ``key, idx, value`` in full, cut to the length of the series."""
    sizes = series.groupBy("key").agg(F.count("*").alias("n"))
    starts = block_starts(sizes, n_samples, block, seed).withColumn("offset", F.explode(F.expr("sequence(0, cast(length as int) - 1)")))
    drawn = starts.select("key", "sample", (F.col("block_no") * F.col("length") + F.col("offset")).alias("place"), (F.col("start") + F.col("offset")).alias("idx"), "n").where("place < n")
    return drawn.join(series, ["key", "idx"]).select("key", "sample", "place", "value")


def statistics(values: DataFrame, keys: tuple[str, ...], days: int = 252) -> DataFrame:
    """Mean, annualised return (null if wiped out) and Sharpe ratio of series of ``value``."""
    growth = F.sum(F.ln(F.when(F.col("value") > -1, F.col("value") + 1)))
    wiped = F.count_if(F.col("value") <= -1) > 0
    return values.groupBy(*keys).agg(
        F.avg("value").alias("mean_daily"),
        F.when(~wiped, F.exp(growth * days / F.count("*")) - 1).alias("annualized"),
        (ratio(F.avg("value"), F.stddev_samp("value")) * math.sqrt(days)).alias("sharpe"),
    )


STATISTICS = ("mean_daily", "annualized", "sharpe")


def _running(series: DataFrame) -> DataFrame:
    """``key, n`` and arrays of running sums (a zero first): values, squares, log growth and days of ruin.

    A series is as long as its sessions, so one row holds it.
    """
    v = F.col("value")
    upto = Window.partitionBy("key").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"p1": v, "p2": v * v, "pl": F.when(v > -1, F.ln(v + 1)).otherwise(0.0), "pw": F.when(v <= -1, 1.0).otherwise(0.0)}
    run = series.select("key", "idx", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
    rows = run.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", *sums))).alias("r"))
    zero = F.array(F.lit(0.0))
    return rows.select("key", "n", *[F.concat(zero, F.col(f"r.{n}")).alias(n) for n in sums])


def draw_statistics(series: DataFrame, n_samples: int = 2000, block: int = 20, seed: int = 42, days: int = 252) -> DataFrame:
    """``key, sample`` and the statistics of each resample of ``key, idx, value``; draws are those of :func:`block_starts`."""
    r = _running(series).withColumn("length", F.greatest(F.lit(1), F.least(F.lit(block), F.col("n"))).cast("int"))
    r = r.withColumn("blocks", F.ceil(F.col("n") / F.col("length")).cast("int"))
    start = f"cast(floor(cast(conv(substring(md5(concat_ws(':', '{seed}', cast(s as string), cast(b as string))), 1, 8), 16, 10) as double) / 4294967296D * (n - length + 1)) as int)"
    size = "cast(least(length, n - b * length) as int)"
    picks = f"transform(sequence(0, blocks - 1), b -> named_struct('a', {start}, 'z', {start} + {size}))"
    total = lambda p: f"aggregate(x.picks, 0D, (acc, y) -> acc + {p}[y.z] - {p}[y.a])"
    sampled = r.withColumn("drawn", F.expr(f"transform(sequence(0, {n_samples - 1}), s -> named_struct('sample', s, 'picks', {picks}))"))
    return _of_sums(sampled.select("key", "n", F.explode(F.expr(f"transform(drawn, x -> named_struct('sample', x.sample, 's1', {total('p1')}, 's2', {total('p2')}, 'sl', {total('pl')}, 'sw', {total('pw')}))")).alias("d")).select("key", "n", "d.*"), days)


def _of_sums(sums: DataFrame, days: int) -> DataFrame:
    """The statistics of resamples from their sums of values, squares, log growth and days of ruin."""
    mean = F.col("s1") / F.col("n")
    spread = F.col("s2") - F.col("s1") * mean
    # running sums of an unchanging series differ from it in the last bits
    deviation = F.when((F.col("n") > 1) & (spread > 1e-12 * F.col("s2")), F.sqrt(spread / (F.col("n") - 1)))
    return sums.select("key", "sample", mean.alias("mean_daily"), F.when(F.col("sw") < 0.5, F.exp(F.col("sl") * days / F.col("n")) - 1).alias("annualized"), (ratio(mean, deviation) * math.sqrt(days)).alias("sharpe"))


def draw_statistics_in_ranges(series: DataFrame, scratch: Scratch, n_samples: int = 2000, block: int = 20, seed: int = 42, days: int = 252) -> DataFrame:
    """:func:`draw_statistics`, the same draws, for series of any length: no row and no task holds one.

    Running sums are taken in ranges of the series; a block's two ends look
    them up by an equi-join on key and place.
    """
    v = F.col("value")
    parts = series.select("key", "idx", v.alias("v1"), (v * v).alias("v2"), F.when(v > -1, F.ln(v + 1)).otherwise(0.0).alias("vl"), F.when(v <= -1, 1.0).otherwise(0.0).alias("vw"))
    names = ("1", "2", "l", "w")
    sums = running(parts, ["key"], ["idx"], {f"p{x}": f"v{x}" for x in names}, scratch).select("key", (F.col("idx") + 1).alias("at"), *[f"p{x}" for x in names])
    starts = block_starts(series.groupBy("key").agg(F.count("*").alias("n")), n_samples, block, seed)
    last = F.col("start") + F.least(F.col("length"), F.col("n") - F.col("block_no") * F.col("length"))
    ends = starts.select("key", "n", "sample", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(-1.0).alias("sign")), F.struct(last.cast("long").alias("at"), F.lit(1.0).alias("sign")))).alias("e")).select("key", "n", "sample", "e.*")
    met = ends.join(sums, ["key", "at"], "left")  # nothing lies before the first place
    total = met.groupBy("key", "n", "sample").agg(*[F.sum(F.col("sign") * F.coalesce(f"p{x}", F.lit(0.0))).alias(f"s{x}") for x in names])
    return _of_sums(total, days)


def block_bootstrap(series: DataFrame, n_samples: int = 2000, block: int = 20, seed: int = 42, level: float = 0.95, days: int = 252, scratch: Scratch | None = None) -> DataFrame:
    """Point, percentile interval and share above zero of each statistic of ``key, idx, value``; long series with ``scratch``."""
    long = lambda df: df.select("key", F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("v")) for s in STATISTICS])).alias("x")).select("key", "x.*")
    draws = long(draw_statistics(series, n_samples, block, seed, days) if scratch is None else draw_statistics_in_ranges(series, scratch, n_samples, block, seed, days))
    tail = (1 - level) / 2
    spread = draws.groupBy("key", "statistic").agg(
        F.count("v").alias("n_draws"), F.percentile("v", F.lit(tail)).alias("low"), F.percentile("v", F.lit(1 - tail)).alias("high"), F.avg((F.col("v") > 0).cast("double")).alias("above_zero")
    )
    point = long(statistics(series, ("key",), days)).withColumnRenamed("v", "point")
    return point.join(spread, ["key", "statistic"])


def bootstrap_difference(a: DataFrame, b: DataFrame, **how) -> DataFrame:
    """Paired bootstrap of the mean of a - b over shared sessions (``key, session, value`` each); none shared is an error."""
    both = a.withColumnRenamed("value", "va").join(b.withColumnRenamed("value", "vb"), ["key", "session"])
    if both.isEmpty():
        raise ValueError("the series share no session")
    idx = (F.row_number().over(Window.partitionBy("key").orderBy("session")) - 1).cast("long")
    series = both.select("key", idx.alias("idx"), (F.col("va") - F.col("vb")).alias("value"))
    return block_bootstrap(series, **how).where("statistic = 'mean_daily'")
