"""Ranks within a group of any size: ranges of the order are ranked side by side and offset by what lies before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch


def ranked(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """``df`` with ``name``, the place (from 0) of each row of ``keys`` by ``order``, and ``<name>_n``, the rows of its group.

    Rows are dealt out by ranges of keys and order, so a group with most rows
    spreads over many tasks; end ``order`` in a column that tells rows apart,
    since rows of equal order are not split.  Places are local ones plus the
    rows of the same group in earlier ranges, a table of one row for each group
    and range.  The dealt rows are written, as both readings must see the same ranges.
    """
    dealt = scratch.write(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    group = Window.partitionBy(*keys)
    before = F.sum("_size").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(group).alias(f"{name}_n"))
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    out = dealt.withColumn(name, local.cast("long")).join(sizes, [*keys, "_range"])
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def medians(df: DataFrame, keys: list[str], value: str, tie: str, scratch: Scratch) -> DataFrame:
    """``keys, median``: the exact median of the non-null values of each group, by selection of its middle ranks."""
    places = ranked(df.where(F.col(value).isNotNull()).select(*keys, value, tie), keys, [value, tie], scratch, "_rank")
    middle: Column = (F.col("_rank") == F.expr("(_rank_n - 1) div 2")) | (F.col("_rank") == F.expr("_rank_n div 2"))
    return places.where(middle).groupBy(*keys).agg(F.avg(value).alias("median"))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """``df`` with running sums ``name`` of the columns ``sums[name]`` up to and with each row, and their totals ``<name>_all``.

    As :func:`ranked`: ranges of the order are summed side by side, and each is
    offset by the sums of the group's earlier ranges, one row for each group
    and range.  No group is sorted in one task, however many rows it has.
    """
    dealt = scratch.write(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    group = Window.partitionBy(*keys)
    parts = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0.0)).alias(f"_{n}") for n in sums], *[F.sum(f"_{n}").over(group).alias(f"{n}_all") for n in sums])
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()]).join(offsets, [*keys, "_range"])
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def in_cells(df: DataFrame, key: str, order: list[str], halo: int, cell_rows: int, scratch: Scratch) -> DataFrame:
    """Rows of long groups cut into cells of ``cell_rows`` consecutive ones, each with the last ``halo`` rows before it.

    ``key``, a text, names the cell instead of the group, so whatever windows
    over ``key`` look back at most ``halo`` rows give the same values on the
    rows that are not ``_halo``; ``_key`` is the group.  Beyond the cells that
    a halo spans rows are read twice at most if ``cell_rows`` >= ``halo``.
    """
    if not 0 <= halo <= cell_rows:
        raise ValueError("a cell must have as many rows as its halo")
    placed = ranked(df, [key], order, scratch, "_place").drop("_place_n")
    cell, within = F.expr(f"_place div {cell_rows}"), F.col("_place") % cell_rows
    cells = F.when(within >= cell_rows - halo, F.array(cell, cell + 1)).otherwise(F.array(cell))
    cut = placed.select("*", F.posexplode(cells).alias("_copy", "_cell")).withColumn("_halo", F.col("_copy") == 1)
    return cut.withColumn("_key", F.col(key)).withColumn(key, F.concat_ws("\u0001", key, F.col("_cell").cast("string"))).drop("_place", "_copy", "_cell")


def scanned(df: DataFrame, keys: list[str], order: list[str], scans: dict[str, tuple[str, str]], scratch: Scratch) -> DataFrame:
    """``df`` with running ``sum``, ``product`` or ``max`` of columns, ``scans[name] = (which, column)``, up to and with each row.

    A scan on two levels: within ranges of the order, and over what whole
    ranges come to, one row for each group and range.
    """
    whole = {"sum": F.sum, "product": F.product, "max": F.max}
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0.0)), "product": lambda a, b: a * F.coalesce(b, F.lit(1.0)), "max": lambda a, b: F.greatest(a, b)}
    dealt = scratch.write(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(*keys, "_range").agg(*[whole[op](c).alias(f"_{n}") for n, (op, c) in scans.items()])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_range", *[whole[op](f"_{n}").over(earlier).alias(f"_{n}") for n, (op, _) in scans.items()])
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[whole[op](c).over(within).alias(n) for n, (op, c) in scans.items()]).join(offsets, [*keys, "_range"])
    return out.withColumns({n: both[op](F.col(n), F.col(f"_{n}")) for n, (op, _) in scans.items()}).drop("_range", *[f"_{n}" for n in scans])
