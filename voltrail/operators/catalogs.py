"""Cell catalogs, labels, splits without leakage, summaries and reference banks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(seed: int, *keys: str) -> list[Column]:
    """A reproducible order: by a digest of key and seed, then by key."""
    return [F.md5(F.concat_ws("|", *keys, F.lit(str(seed)))), *map(F.col, keys)]


def cell_catalog(cycles: DataFrame, meta: Sequence[str]) -> DataFrame:
    """Per cell: the metadata of its first cycle and its number of cycles."""
    first = F.min_by(F.struct(*meta), "cycle_idx").alias("m")
    return cycles.groupBy("cell_uid").agg(first, F.count("*").alias("n_cycles")).select("cell_uid", "m.*", "n_cycles")


def condition_label() -> Column:
    """By dataset: folder and condition, batch and condition, group of the id, or buckets."""
    c = F.col
    known = lambda x, other: F.coalesce(F.nullif(c(x), F.lit("")), F.lit(other))
    buckets = F.concat_ws(":", known("temperature_bucket", "unknown_temp"), known("charge_rate_bucket", "unknown_rate"))
    return (
        F.when(c("source_dataset") == "tju", F.concat_ws(":", F.element_at(F.split(c("raw_cell_id"), "/"), 1), F.split_part(F.element_at(F.split(c("raw_cell_id"), "/"), -1), F.lit("-#"), F.lit(1))))
        .when(c("source_dataset") == "xjtu", F.concat_ws(":", c("folder"), F.split_part(c("raw_cell_id"), F.lit("_battery-"), F.lit(1))))
        .when(c("source_dataset") == "hust", F.concat(F.lit("hust_group_"), F.split_part(c("raw_cell_id"), F.lit("-"), F.lit(1))))
        .when(c("source_dataset") == "mit", F.concat(F.lit("mit_fastcharge:"), buckets))
        .otherwise(F.concat_ws(":", known("discharge_policy_family", "unknown_policy"), buckets))
    )


def stratum() -> Column:
    return F.concat_ws("|", "source_dataset", "chemistry_family", "condition_label")


@dataclass(frozen=True)
class DomainRules:
    mode: str = "protocol_aware"
    fastcharge: tuple[str, ...] = ("fastcharge",)
    multistage: tuple[str, ...] = ("multistage",)
    irregular: tuple[str, ...] = ("irregular", "random_walk", "satellite")
    chemistry: str = "Unknown"
    policy: str = "regular"
    full: str = "full"


def domain_label(rules: DomainRules = DomainRules()) -> Column:
    given = lambda c, other: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(other))
    chemistry, policy, full = given("chemistry_family", rules.chemistry), given("discharge_policy_family", rules.policy), given("full_or_partial", rules.full)
    if rules.mode == "chemistry_only":
        return chemistry
    if rules.mode == "chemistry_policy":
        return F.concat_ws("_", chemistry, policy)
    kind = (
        F.when(policy.isin(*rules.fastcharge), F.lit("fastcharge"))
        .when(policy.isin(*rules.multistage), F.lit("multistage"))
        .when(policy.isin(*rules.irregular), F.concat(F.lit("irregular_"), full))
        .when(full == "full", F.lit("regular"))
        .otherwise(F.concat(F.lit("regular_"), full))
    )
    return F.concat_ws("_", chemistry, kind)


def glob(pattern: str) -> str:
    """A file pattern (*, ?, [..], [!..]) as a regular expression for whole names."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        close = pattern.find("]", at + 2) if c == "[" else -1
        if close > 0:
            inner = pattern[at + 1 : close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else "\\" + inner if inner[0] == "^" else inner) + "]"
            at = close
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        at += 1
    return rf"(?s)\A{out}\z"


def exclude(cells: DataFrame, chemistries: Sequence[str] = (), path_parts: Sequence[str] = (), prefixes: Sequence[str] = (), patterns: Sequence[str] = (), require: bool = True) -> DataFrame:
    """Cells without the named chemistries, and without paths or ids that match; an error if none is left."""
    drop = [F.col("chemistry_family").isin(*chemistries)] if chemistries else []
    drop += [F.col("file_path").contains(p) for p in path_parts] + [F.col("raw_cell_id").startswith(p) for p in prefixes] + [F.col("raw_cell_id").rlike(glob(p)) for p in patterns]
    out = cells.where(~F.coalesce(reduce(lambda a, b: a | b, drop), F.lit(False))) if drop else cells
    if require and out.isEmpty():
        raise ValueError("no cells remain after exclusion")
    return out


def first_cells(cells: DataFrame, n: int, group: str = "source_dataset") -> DataFrame:
    """The first n cells of each group in order of their ids."""
    return cells.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy("raw_cell_id"))).where(F.col("_k") <= n).drop("_k")


def split_by_predicate(cells: DataFrame, source: Column, target: Column, val_frac: float = 0.2, few_shot: int = 0, seed: int = 0, require: bool = False) -> DataFrame:
    """Split: source_train, source_val (a share of each dataset), target_support (few cells), target_query, unassigned."""
    side = F.when(source, "source").when(target, "target").otherwise("unassigned")
    df = cells.withColumn("_side", side)
    n = F.count("*").over(W.partitionBy("_side", "source_dataset"))
    rank = F.row_number().over(W.partitionBy("_side", "source_dataset").orderBy(*draw(seed, "cell_uid")))
    n_val = F.when((n > 1) & F.lit(val_frac > 0), F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(val_frac)).cast("long")))).otherwise(0)
    # few by their parameter: each task sends so many at most
    chosen = df.where("_side = 'target'").orderBy(*draw(seed, "cell_uid")).limit(few_shot).select("cell_uid", F.lit(True).alias("_few"))
    df = df.withColumns({"_rank": rank, "_val": n_val}).join(F.broadcast(chosen), "cell_uid", "left")
    if require:
        have = {r["_side"] for r in df.select("_side").distinct().collect()}
        if not {"source", "target"} <= have:
            raise ValueError("a side of the split is empty")
    split = (
        F.when(F.col("_side") == "source", F.when(F.col("_rank") <= F.col("_val"), "source_val").otherwise("source_train"))
        .when(F.col("_side") == "target", F.when(F.col("_few"), "target_support").otherwise("target_query"))
        .otherwise("unassigned")
    )
    return df.withColumn("split", split).drop("_side", "_rank", "_val", "_few")


#: Cells for training, validation and support in strata of at least so many cells.
STRATIFIED = ((20, 4, 2, 2), (8, 2, 1, 1), (4, 1, 1, 1), (3, 1, 0, 1), (2, 1, 0, 0), (1, 0, 0, 0))


def split_stratified(cells: DataFrame, strata: str = "split_stratum", min_query: int = 1, seed: int = 0, sizes: Sequence[tuple[int, int, int, int]] = STRATIFIED) -> DataFrame:
    """Few-shot split within strata; training, validation and support share what the query cells leave, in that order."""
    n = F.count("*").over(W.partitionBy(strata))
    rank = F.row_number().over(W.partitionBy(strata).orderBy(*draw(seed, "cell_uid")))
    df = cells.withColumns({"_n": n, "_rank": rank})

    def want(i: int) -> Column:
        out = F.when(F.col("_n") >= sizes[0][0], sizes[0][i])
        for s in sizes[1:]:
            out = out.when(F.col("_n") >= s[0], s[i])
        return out.otherwise(0)

    budget = F.greatest(F.col("_n") - min_query, F.lit(0))
    train = F.least(want(1), budget)
    val = F.least(want(2), budget - train)
    support = F.least(want(3), budget - train - val)
    r = F.col("_rank")
    split = F.when(r <= train, "source_train").when(r <= train + val, "source_val").when(r <= train + val + support, "target_support").otherwise("target_query")
    return df.withColumn("split", split).drop("_n", "_rank")


def leaks(manifest: DataFrame) -> DataFrame:
    """Cells that are in more than one split."""
    return manifest.groupBy("cell_uid").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def assert_no_leakage(manifest: DataFrame) -> None:
    if not leaks(manifest).isEmpty():
        raise ValueError("a cell is in more than one split")
    both = manifest.where("split = 'source_train'").select("cell_uid").intersect(manifest.where("split = 'target_query'").select("cell_uid"))
    if not both.isEmpty():
        raise ValueError("training and query cells overlap")


def missing_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, the share of rows that lack it, all in one pass; empty strings lack it too."""
    kinds = dict(df.dtypes)
    lacks = lambda c: (F.col(c).isNull() | ((F.col(c) == "") if kinds[c] == "string" else F.lit(False))).cast("double")
    one = df.agg(*(F.avg(lacks(c)).alias(c) for c in columns))
    return one.unpivot([], list(columns), "column", "missing_ratio")


def sample_cells(cells: DataFrame, count: int, group: str = "source_dataset", seed: int = 0) -> DataFrame:
    """So many cells of each group, drawn by digest."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*draw(seed, "cell_uid")))
    return cells.withColumn("_k", rank).where(F.col("_k") <= count).drop("_k")


def bank(rows: DataFrame, name: str, splits: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of some splits as a named bank, numbered within their cells."""
    number = F.row_number().over(W.partitionBy("cell_uid").orderBy(*order)) - 1
    return rows.where(F.col("split").isin(*splits)).withColumns({"bank": F.lit(name), "bank_row": number.cast("long")})
