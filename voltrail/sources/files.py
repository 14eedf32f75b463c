"""Readers of raw measurement files with fixed schemas, and writers and readers of banks and results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.columns import known, text_or_unknown
from voltrail.functions.ranks import numbered

CHEMISTRY_OF_FOLDER = {"Dataset_1_NCA_battery": "NCA", "Dataset_2_NCM_battery": "NCM", "Dataset_3_NCM_NCA_battery": "NCM_NCA"}


def csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV files with a header, read as text by name and cast; what is no number is null. file: the path; sample: the row."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    cast = lambda c, t: (known(F.expr(f"try_cast(`{c}` AS double)")).cast(t) if t != "string" else F.col(f"`{c}`"))
    return raw.select(*(cast(c, t).alias(c) for c, t in columns.items()), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("sample"))


def stem(c: str = "file") -> Column:
    return F.url_decode(F.regexp_extract(c, r"([^/]+)\.csv$", 1))


def folder(c: str = "file") -> Column:
    return F.url_decode(F.regexp_extract(c, r"([^/]+)/[^/]+$", 1))


def _raw(df: DataFrame, dataset: str, cell: Column, **columns: Column) -> DataFrame:
    """The common schema of raw samples."""
    names = ["cycle_idx", "time", "voltage", "current", "capacity", "temperature", "step", "dq", "q_charge", "q_discharge"]
    kinds = dict.fromkeys(names, "double") | {"cycle_idx": "int", "step": "string"}
    parts = [columns.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names]
    return df.select(F.lit(dataset).alias("source_dataset"), cell.alias("raw_cell_id"), F.col("file").alias("file_path"), "sample", *parts)


def read_hust(spark: SparkSession, root: str) -> DataFrame:
    """One file per cell; mA and mAh, a constant 30 degrees."""
    d = csv(spark, f"{root}/*.csv", {"cycle_index": "int", "Status": "string", "Current (mA)": "double", "Voltage (V)": "double", "Capacity (mAh)": "double", "Time (s)": "double", "dq": "double"})
    c = F.col
    return _raw(d, "hust", stem(), cycle_idx=c("cycle_index"), time=c("Time (s)"), voltage=c("Voltage (V)"), current=c("Current (mA)") / 1000, capacity=c("Capacity (mAh)") / 1000, temperature=F.lit(30.0), step=c("Status"), dq=c("dq") / 1000)


def read_tju(spark: SparkSession, root: str) -> DataFrame:
    """Dataset folders; capacity by the sign of the current, temperature and chemistry from the names."""
    d = csv(spark, f"{root}/Dataset_*/*.csv", {"time/s": "double", "control/V": "double", "Ecell/V": "double", "<I>/mA": "double", "Q discharge/mA.h": "double", "Q charge/mA.h": "double", "cycle number": "int"})
    c = F.col
    capacity = F.when(c("<I>/mA") >= 0, c("`Q charge/mA.h`")).otherwise(c("`Q discharge/mA.h`")) / 1000
    control = F.coalesce("control/V", F.lit(0.0))
    step = F.when(F.abs(control) < 1e-6, "constant current").when(control > 0, "constant voltage").otherwise("rest")
    out = _raw(d, "tju", F.concat_ws("/", folder(), stem()), cycle_idx=c("cycle number"), time=c("time/s"), voltage=c("Ecell/V"), current=c("<I>/mA") / 1000, capacity=capacity, temperature=F.regexp_extract(stem(), r"CY(\d+)", 1), step=step, q_charge=c("`Q charge/mA.h`") / 1000, q_discharge=c("`Q discharge/mA.h`") / 1000)
    pairs = [F.lit(x) for kv in CHEMISTRY_OF_FOLDER.items() for x in kv]
    return out.withColumn("chemistry_family", F.create_map(*pairs)[F.split_part("raw_cell_id", F.lit("/"), F.lit(1))])


def read_xjtu(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Raw samples, and the summaries per cycle, of the sibling files in batch folders."""
    d = csv(spark, f"{root}/Batch-*/*_data.csv", {"cycle_index": "int", "relative_time_min": "double", "voltage_V": "double", "current_A": "double", "capacity_Ah": "double", "temperature_C": "double", "description": "string"})
    c = F.col
    raw = _raw(d, "xjtu", F.regexp_replace(stem(), "_data$", ""), cycle_idx=c("cycle_index"), time=c("relative_time_min") * 60, voltage=c("voltage_V"), current=c("current_A"), capacity=c("capacity_Ah"), temperature=c("temperature_C"), step=c("description"))
    numbers = ["charge_capacity_Ah", "discharge_capacity_Ah", "charge_mean_voltage", "discharge_mean_voltage", "charge_power_Wh", "discharge_power_Wh"]
    s = csv(spark, f"{root}/Batch-*/*_summary.csv", {"cycle_index": "int"} | dict.fromkeys(numbers, "double"))
    return raw, s.select(F.regexp_replace(stem(), "_summary$", "").alias("raw_cell_id"), F.col("cycle_index").alias("cycle_idx"), *numbers)


def xjtu_cycles(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """soh by the first discharge capacity, mean voltage of the two sides that are known, statistics of samples joined."""
    from voltrail.functions.columns import by_cell

    w = by_cell("raw_cell_id")
    first = F.first("discharge_capacity_Ah", True).over(w.rowsBetween(-(1 << 31), 1 << 31))
    own = F.when(F.row_number().over(w) == 1, first).otherwise(F.col("charge_capacity_Ah"))
    a, b = F.col("charge_mean_voltage"), F.col("discharge_mean_voltage")
    out = summary.withColumn("soh", own / first).withColumn("voltage_mean", F.coalesce((a + b) / 2, a, b))
    extra = [c for c in stats.columns if c not in ("raw_cell_id", "cycle_idx")]
    joined = out.drop(*(c for c in extra if c != "voltage_mean")).join(stats.withColumnRenamed("voltage_mean", "_v"), ["raw_cell_id", "cycle_idx"], "left")
    return joined.withColumn("voltage_mean", F.coalesce("_v", "voltage_mean")).drop("_v") if "voltage_mean" in extra else joined


def read_mit(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Raw samples of the interpolated cycles, and the summaries with the protocol."""
    c = F.col
    d = csv(spark, f"{root}/*_structure_cycles_interpolated.csv", {"cycle_index": "int", "voltage": "double", "current": "double", "temperature": "double", "charge_capacity": "double", "discharge_capacity": "double", "step_type": "string"})
    cell = lambda suffix: F.regexp_replace(stem(), f"_structure_{suffix}$", "")
    capacity = F.when(c("current") >= 0, c("charge_capacity")).otherwise(c("discharge_capacity"))
    raw = _raw(d, "mit", cell("cycles_interpolated"), cycle_idx=c("cycle_index"), time=c("sample"), voltage=c("voltage"), current=c("current"), capacity=capacity, temperature=c("temperature"), step=c("step_type"))
    numbers = ["discharge_capacity", "charge_capacity", "discharge_energy", "charge_energy", "temperature_average", "temperature_maximum", "temperature_minimum", "charge_duration", "charge_throughput"]
    s = csv(spark, f"{root}/*_structure_summary.csv", {"cycle_index": "int", "date_time_iso": "string"} | dict.fromkeys(numbers, "double"))
    s = s.select(cell("summary").alias("raw_cell_id"), F.col("cycle_index").alias("cycle_idx"), F.col("date_time_iso").alias("timestamp"), *numbers)
    m = csv(spark, f"{root}/*_structure_meta.csv", {"protocol": "string"}).select(cell("meta").alias("raw_cell_id"), "protocol")
    return raw, s.join(m, "raw_cell_id", "left")


def mit_cycles(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """Mean voltage from energies by capacities (0 counts as missing); what the summary lacks comes from the samples."""
    ratio = lambda e, q: F.nullif(F.col(e), F.lit(0.0)) / F.nullif(F.col(q), F.lit(0.0))
    a, b = ratio("discharge_energy", "discharge_capacity"), ratio("charge_energy", "charge_capacity")
    base = summary.withColumn("voltage_mean", F.coalesce((a + b) / 2, a, b)).withColumnsRenamed({"temperature_average": "temp_mean", "temperature_maximum": "temp_max", "temperature_minimum": "temp_min"})
    extra = [c for c in stats.columns if c not in ("raw_cell_id", "cycle_idx")]
    joined = base.join(stats.withColumnsRenamed({c: f"_{c}" for c in extra}), ["raw_cell_id", "cycle_idx"], "left")
    for c in extra:
        joined = joined.withColumn(c, F.coalesce(c, f"_{c}") if c in base.columns else F.col(f"_{c}")).drop(f"_{c}")
    return joined


READERS = {"hust": read_hust, "tju": read_tju, "xjtu": read_xjtu, "mit": read_mit}


def wide_series(df: DataFrame, columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """A wide table as (series, position, value): the named columns, or the numeric ones but the first column. Positions are 0, 1, ... over
    all partitions, by the columns of the order and then as the files have the rows: by path, block and row."""
    numeric = [c for c, t in df.dtypes[1:] if t in ("double", "float", "int", "bigint")]
    chosen = list(columns or numeric)
    try:
        places = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})
    except AnalysisException:  # not as read from files
        places = df.withColumns({"_file": F.lit(""), "_block": F.lit(0)})
    places = numbered(places.withColumn("_row", F.monotonically_increasing_id()), [*order, "_file", "_block", "_row"], "position")
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return places.select("position", *(quoted(c).cast("double").alias(c) for c in chosen)).unpivot(["position"], [quoted(c) for c in chosen], "series", "value")


def union_cycles(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """All parts' cycles in one order of columns; what a part lacks is null, of the type that the others have. Numbers of several types
    become double, other mixtures text; a column that no part has is a null double."""
    kinds: dict[str, str] = {}
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    for p in parts:
        for c, t in p.dtypes:
            if (have := kinds.setdefault(c, t)) != t:
                kinds[c] = "double" if {have, t} <= numbers else "string"
    out = None
    for p in parts:
        one = p.select(*((F.col(f"`{c}`") if c in p.columns else F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in columns))
        out = one if out is None else out.unionByName(one)
    return out


def write_bank(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.partitionBy(by).parquet(path)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """A bank as it was written, missing texts as unknown."""
    df = spark.read.parquet(path)
    texts = {c for c, t in df.dtypes if t == "string"}
    return df.select(*(text_or_unknown(c) if c in texts else F.col(c) for c in df.columns))


def config_hash(config: dict) -> str:
    """The first 16 hex digits of the SHA-1 of the settings as JSON with sorted keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def write_results(results: DataFrame, path: str, config: dict) -> str:
    """Results under a folder of their settings' hash; returns the folder."""
    target = f"{path}/config_hash={config_hash(config)}"
    results.write.mode("overwrite").parquet(target)
    return target


def cached_results(queries: DataFrame, path: str, config: dict, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results (a column query and others) of the queries (a column query) under these settings.

    What is missing in the settings' folder is computed, from the missing queries alone, and kept there: the queries asked, their results,
    and last an entry in the manifest, so that a write that broke off counts as none. Queries without results are known to have none.
    """
    spark, folder = queries.sparkSession, f"{path}/config_hash={config_hash(config)}"

    def committed(kind: str) -> DataFrame | None:
        try:
            parts = [r["part"] for r in spark.read.schema("part string, config string").parquet(f"{folder}/manifest/*").collect()]  # a row per write
        except AnalysisException:  # nothing there yet
            return None
        return spark.read.parquet(*(f"{folder}/{kind}/{p}" for p in sorted(parts))) if parts else None

    asked, known = queries.select("query").distinct(), committed("asked")
    missing = asked if known is None else asked.join(known, "query", "left_anti")
    part = uuid4().hex
    missing.write.parquet(f"{folder}/asked/{part}")
    missing = spark.read.schema(asked.schema).parquet(f"{folder}/asked/{part}")
    if known is None or not missing.isEmpty():
        compute(missing).write.parquet(f"{folder}/results/{part}")
        entry = spark.createDataFrame([(part, json.dumps(config, sort_keys=True))], "part string, config string")
        entry.coalesce(1).write.parquet(f"{folder}/manifest/{part}")
    return committed("results").join(asked, "query", "left_semi")


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """df as a table of the warehouse, in buckets by the key: joins on the key move the other side alone. Its name gets an ending of its own."""
    spark = df.sparkSession
    table = f"{name}_{uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
