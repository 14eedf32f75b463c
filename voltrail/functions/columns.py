"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

EARLIEST = W.unboundedPreceding


def by_cell(key: str = "cell_uid", order: str = "cycle_idx") -> WindowSpec:
    return W.partitionBy(key).orderBy(order)


def whole_cell(key: str = "cell_uid") -> WindowSpec:
    return W.partitionBy(key)


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, as results are compared."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6)
    return out.alias(name) if name else out


def median(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.5))


def known(c: Column | str) -> Column:
    """NaN and null as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def array_of(c: Column, f) -> Column:
    return F.transform(c, f)


def array_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def array_count(c: Column) -> Column:
    return F.size(F.filter(c, lambda x: x.isNotNull()))


def array_mean(c: Column) -> Column:
    """Mean of the elements that are known; null if none is."""
    n = array_count(c)
    return F.when(n > 0, array_sum(c) / n)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f and its lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def array_std(c: Column) -> Column:
    """Population deviation of the elements that are known."""
    return bound(array_mean(c), lambda m: F.sqrt(array_mean(F.transform(c, lambda x: (x - m) * (x - m)))))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), c))))


def text_or_unknown(c: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown")).alias(c)
