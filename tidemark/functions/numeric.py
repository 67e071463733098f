"""Column expressions with one notion of a missing value: null, never NaN or infinity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Decimals of every float that leaves a query: engines differ in the last bits only.
DECIMALS = 8


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is zero or either is null."""
    return F.try_divide(_col(a), _col(b))


def finite(x: Column | str) -> Column:
    """x, with NaN and the infinities made null."""
    x = _col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def rounded(x: Column | str, decimals: int = DECIMALS) -> Column:
    """Rounded, with minus zero made zero."""
    return F.round(_col(x), decimals) + F.lit(0.0)


def every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def by_session(*keys: str) -> WindowSpec:
    """Sessions of a panel member in order."""
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("session")


def trailing(n: int, *keys: str) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return by_session(*keys).rowsBetween(-(n - 1), 0)


def upto(*keys: str) -> WindowSpec:
    """All rows up to the current one."""
    return by_session(*keys).rowsBetween(Window.unboundedPreceding, 0)


def full(n: int, counted: Column, value: Column) -> Column:
    """A trailing statistic that needs all n values; null while any of them is missing."""
    return F.when(F.count(counted).over(trailing(n)) == n, value)


def iso(session: str = "session") -> Column:
    """A session as text."""
    return F.date_format(session, "yyyy-MM-dd")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
