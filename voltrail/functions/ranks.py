"""Places in an order and quantiles, without a task that holds all rows.

Places: rows are dealt to partitions by ranges of the order and sorted there; a partition's rows come behind those of the partitions
before it, whose sizes are a row per partition. Quantiles: values are counted in bins between the smallest and the largest one, then
only in the bin that holds the rank, until few values are left or the bin has one value. Each round is one aggregation over bins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Sequence
from itertools import accumulate
from math import ceil, floor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltrail.functions.storage import stored

#: Bins of a round, and values that are looked through at once.
BINS, FEW = 1024, 20_000


def _behind(df: DataFrame, part: str, key: Sequence[str] = ()) -> DataFrame:
    """Per part (and key): _before, the rows of the parts before it. Parts are as few as partitions."""
    sizes = df.groupBy(part, *key).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*key).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    return sizes.select(part, *key, F.coalesce(before, F.lit(0)).alias("_before"))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """df with each row's place (from 0) in the order among all rows. The order should tell rows apart: among equal ones places are
    dealt as they come, and equal rows are sorted in one task. The result is a stored table, so its places stay as they are."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = stored(ordered, "ordered").withColumns({"_part": F.shiftright("_id", 33), name: F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    starts = _behind(kept, "_part")
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_id", "_part", "_before")


def ranked_within(df: DataFrame, key: Sequence[str], value: str, tie: str, tiles: int | None = None) -> DataFrame:
    """df with, within its key, {value}_rank (from 1; equal values share the mean of their places) and, if tiles are asked for, {value}_tile
    (1 to so many, as even as possible; equal values are told apart by tie). Neither a key's rows nor equal values meet in one task."""
    placed = numbered(df, [*key, value, tie], "_place")
    sizes = placed.groupBy(*key).agg(F.min("_place").alias("_first"), F.count("*").alias("_size"))
    ties = placed.groupBy(*key, value).agg(F.min("_place").alias("_low"), F.count("*").alias("_many")).where("_many > 1")
    rank = F.when(F.col("_many").isNull(), F.col("_place")).otherwise(F.col("_low") + (F.col("_many") - 1) / 2) - F.col("_first") + 1
    out = placed.join(sizes, list(key)).join(ties, [*key, value], "left").withColumn(f"{value}_rank", rank.cast("double"))
    if tiles:
        at, small = F.col("_place") - F.col("_first"), F.floor(F.col("_size") / tiles)
        more = F.col("_size") % tiles  # the first tiles have one more
        tile = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / F.greatest(small, F.lit(1))))
        out = out.withColumn(f"{value}_tile", (tile + 1).cast("int"))
    return out.drop("_place", "_first", "_size", "_low", "_many")


def shuffled(df: DataFrame, key: str, seeds: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """df once for each seed, with the columns of another row in {column}_other: a permutation of all rows, the same for all columns, by two orders of digests of the key."""
    digest = lambda side: F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(side), F.col("seed").cast("string")))
    many = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    left = numbered(many.withColumn("_digest", digest("a")), ["seed", "_digest", key], "_place").drop("_digest")
    right = many.select("seed", key, digest("b").alias("_digest"), *(F.col(c).alias(f"{c}_other") for c in columns))
    return left.join(numbered(right, ["seed", "_digest", key], "_place").drop("_digest", key), ["seed", "_place"]).drop("_place")


class Summary(NamedTuple):
    """Of a key's known values: how many, their mean and population deviation, and the quantiles asked for."""

    n: int
    mean: float
    std: float
    quantiles: list[float]


def sketched(long: DataFrame, key: str, value: str, probabilities: Sequence[float], accuracy: int = 10_000) -> dict[object, Summary]:
    """Per key, in one pass: a summary with approximate quantiles, by sketches that merge. A quantile is a value of the table, and its rank differs
    from the one asked for by at most one in ``accuracy`` of the key's values."""
    known = long.where(F.col(value).isNotNull() & ~F.isnan(value))
    parts = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile_approx(value, list(probabilities), accuracy).alias("q")]
    return {r[key]: Summary(r["n"], r["mean"], r["std"], list(r["q"])) for r in known.groupBy(key).agg(*parts).collect()}  # a row per key


def exact(long: DataFrame, key: str, value: str, probabilities: Sequence[float], few: int = FEW, bins: int = BINS, again: bool = False) -> dict[object, Summary]:
    """Per key: a summary with exact quantiles, interpolated between neighbours. There may be many rows, but only as many keys as
    the driver can hold (names of columns, dimensions); a key without known values is missing. Infinities count at the ends. The values are stored for
    the passes to come, or each pass makes them again, which takes no disk and suits rows that come from a stored table."""
    double = F.col(value).cast("double")
    values = long.select(F.col(key).alias("key"), double.alias("x")).where(double.isNotNull() & ~F.isnan(double))
    values = values if again else stored(values, "values")
    inf = float("inf")
    finite = F.when(F.abs("x") < inf, F.col("x"))
    parts = [F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count(F.when(F.col("x") == -inf, 1)).alias("low"), F.count(finite).alias("m"), F.min(finite).alias("a"), F.max(finite).alias("b")]
    ends = values.groupBy("key").agg(*parts).collect()
    found: dict[tuple, float] = {}  # by key and rank
    wanted: dict[object, list[float]] = {}
    open_: dict[tuple, list[tuple[int, int]]] = defaultdict(list)  # by key and the ends of an interval: rank, and the rank within the interval
    for r in ends:
        wanted[r["key"]] = [p * (r["n"] - 1) for p in probabilities]
        for rank in {f(w) for w in wanted[r["key"]] for f in (floor, ceil)}:
            within = rank - r["low"]
            if 0 <= within < r["m"]:
                open_[r["key"], r["a"], r["b"]].append((rank, within))
            else:
                found[r["key"], rank] = -inf if within < 0 else inf
    held = {r["key"]: r["m"] for r in ends}
    sizes = {i: held[i[0]] for i in open_}

    def settle() -> None:
        for key, a, b in [i for i in open_ if i[1] == i[2]]:
            found.update({(key, rank): a for rank, _ in open_.pop((key, a, b))})

    settle()
    kind = values.schema["key"].dataType.simpleString()
    while open_:
        # as many rows as quantiles are asked for at most
        asked = F.broadcast(values.sparkSession.createDataFrame([(k, a, b) for k, a, b in open_], f"k {kind}, a double, b double"))
        inside = values.join(asked, (F.col("key") == F.col("k")) & F.col("x").between(F.col("a"), F.col("b")))
        counted: dict[tuple, list] = defaultdict(list)
        if sum(sizes[i] for i in open_) <= few:
            for r in inside.groupBy("key", "a", "b", "x").count().collect():
                counted[r["key"], r["a"], r["b"]].append((r["x"], r["x"], r["count"]))
        else:  # halves, so that no difference overflows
            share = (F.col("x") / 2 - F.col("a") / 2) / (F.col("b") / 2 - F.col("a") / 2)
            bin_ = F.least(F.lit(bins - 1), F.floor(share * bins))
            for r in inside.groupBy("key", "a", "b", bin_.alias("bin")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("count")).collect():
                counted[r["key"], r["a"], r["b"]].append((r["low"], r["high"], r["count"]))
        before, open_ = open_, defaultdict(list)
        for (key, a, b), ranks in before.items():
            parts = sorted(counted[key, a, b])
            upto = list(accumulate(n for _, _, n in parts))
            for rank, within in ranks:
                at = bisect_right(upto, within)
                low, high, n = parts[at]
                open_[key, low, high].append((rank, within - (upto[at] - n)))
                sizes[key, low, high] = n
        settle()

    def between(key, w: float) -> float:
        low, high = found[key, floor(w)], found[key, ceil(w)]
        if low == high or abs(low) == inf:
            return low
        return low + (high - low) * (w - floor(w))

    return {r["key"]: Summary(r["n"], r["mean"], r["std"], [between(r["key"], w) for w in wanted[r["key"]]]) for r in ends}


def columns_as_rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """key (the name) and x of each column, as ``exact`` takes them."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("key"), c.cast("double").alias("x")) for n, c in columns.items()))).alias("p")).select("p.*")


def summaries(df: DataFrame, columns: dict[str, Column], probabilities: Sequence[float], accuracy: int | None = None) -> dict[str, Summary]:
    """Of each column over all rows; exact, or with an accuracy approximate. Columns without known values are missing."""
    long = columns_as_rows(df, columns)
    return sketched(long, "key", "x", probabilities, accuracy) if accuracy else exact(long, "key", "x", probabilities)
