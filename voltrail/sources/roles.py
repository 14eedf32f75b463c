"""Tables in the role of cycling data: events as cycles, line items as raw samples, customers as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell_uid(key: str):
    """The key in five digits, or as many more as it has."""
    text = F.col(key).cast("string")
    return F.concat(F.lit("cell_"), F.lpad(text, F.greatest(F.lit(5), F.length(text)), F.lit("0")))


def cell_uid_sql(key: str) -> str:
    return f"'cell_' || lpad({key}::VARCHAR, greatest(5, length({key}::VARCHAR))::INTEGER, '0')"


def pick(c, values: list[str]):
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user (cell) and event (cycle), with gaps and dropouts."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("cell_uid").orderBy("ts", "event_id")  # as what follows, so that events move once
    e = e.withColumn("cell_uid", cell_uid("user_id")).withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    value, event = F.col("value"), F.col("event_id")
    return e.select(
        "cell_uid", "user_id", "event_id", "event_type", "props", "ts", "pos", (F.col("pos") + 1).alias("cycle_idx"),
        F.when(event % 17 != 0, value).alias("capacity"),
        F.when(event % 23 == 0, 0.0).when(event % 17 != 0, value).alias("raw_capacity"),
        (3 + value / 500).alias("voltage_mean"), (3.1 + value / 500 + event % 7 / 100).alias("voltage_max"), (2.9 + value / 500 - event % 5 / 100).alias("voltage_min"),
        (20.0 + event % 25).alias("temp_mean"), (20.0 + event % 25 + event % 3).alias("temp_max"), (18.0 + event % 25).alias("temp_min"),
        (value / 100 - 1).alias("current_mean"), (value / 100 - 0.5).alias("current_max"), (value / 100 - 1.5).alias("current_min"),
        F.when(F.col("user_id") % 5 != 0, value * 0.01).alias("energy_charge"), (value * 0.009).alias("energy_discharge"),
        F.when(F.col("user_id") % 2 == 0, value * 0.5).alias("charge_throughput"), F.when(F.col("user_id") % 3 != 0, value * 0.45).alias("discharge_throughput"),
        pick(F.col("user_id"), ["xjtu", "tju", "hust", "mit"]).alias("source_dataset"),
        pick(F.col("user_id"), ["LFP", "NCM", "NCA"]).alias("chemistry_family"),
    )


#: The same in DuckDB, as the beginning of a WITH clause.
CYCLES_SQL = f"""WITH cycles AS (
  SELECT {cell_uid_sql("user_id")} AS cell_uid, user_id, event_id, event_type, props, ts, pos, pos + 1 AS cycle_idx,
    CASE WHEN event_id % 17 != 0 THEN value END AS capacity,
    CASE WHEN event_id % 23 = 0 THEN 0.0 WHEN event_id % 17 != 0 THEN value END AS raw_capacity,
    3 + value / 500 AS voltage_mean, 3.1::DOUBLE + value / 500 + event_id % 7 / 100 AS voltage_max, 2.9::DOUBLE + value / 500 - event_id % 5 / 100 AS voltage_min,
    (20 + event_id % 25)::DOUBLE AS temp_mean, (20 + event_id % 25 + event_id % 3)::DOUBLE AS temp_max, (18 + event_id % 25)::DOUBLE AS temp_min,
    value / 100 - 1 AS current_mean, value / 100 - 0.5::DOUBLE AS current_max, value / 100 - 1.5::DOUBLE AS current_min,
    CASE WHEN user_id % 5 != 0 THEN value * 0.01::DOUBLE END AS energy_charge, value * 0.009::DOUBLE AS energy_discharge,
    CASE WHEN user_id % 2 = 0 THEN value * 0.5::DOUBLE END AS charge_throughput, CASE WHEN user_id % 3 != 0 THEN value * 0.45::DOUBLE END AS discharge_throughput,
    ['xjtu', 'tju', 'hust', 'mit'][user_id % 4 + 1] AS source_dataset, ['LFP', 'NCM', 'NCA'][user_id % 3 + 1] AS chemistry_family
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events))"""


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier (cell), shipping year (cycle) and line item (sample)."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    cycle = F.year("l_shipdate").cast("long")
    order = W.partitionBy("l_suppkey", cycle).orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    sign = F.when(F.col("l_returnflag") == "N", 1.0).otherwise(-1.0)
    return l.select(
        F.col("l_suppkey").alias("cell"), cycle.alias("cycle"), (F.row_number().over(order) - 1).cast("long").alias("sample"),
        F.unix_timestamp("l_shipdate").cast("double").alias("clock"),
        (2.6 + 1.2 * F.col("l_extendedprice") / 105000).alias("voltage"), (sign * F.col("l_quantity") / 10).alias("current"),
        (F.sum("l_quantity").over(order.rowsBetween(W.unboundedPreceding, 0)) / 1000).alias("capacity"), (20 + 100 * F.col("l_tax")).alias("temperature"),
        F.when(F.col("l_returnflag") == "N", "charge").when(F.col("l_returnflag") == "A", "constant voltage charge").otherwise("discharge").alias("step"),
    )


RAW_SQL = """WITH raw AS (
  SELECT l_suppkey AS cell, year(l_shipdate) AS cycle, row_number() OVER o - 1 AS sample, epoch(l_shipdate)::DOUBLE AS clock,
    2.6::DOUBLE + 1.2::DOUBLE * l_extendedprice / 105000 AS voltage, CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END * l_quantity / 10 AS current,
    sum(l_quantity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1000 AS capacity, 20 + 100 * l_tax AS temperature,
    CASE l_returnflag WHEN 'N' THEN 'charge' WHEN 'A' THEN 'constant voltage charge' ELSE 'discharge' END AS step
  FROM lineitem WINDOW o AS (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber))"""
