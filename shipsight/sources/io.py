"""Reading and writing tables: declared schemas, alias-matched columns, named outputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_silver(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Declared schema, never inferred; CSV is the fallback format."""
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).parquet(path)


def changed_at(spark: SparkSession, path: str) -> datetime | None:
    """When the newest file under a path was written, None where there is no such path."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # The content column is pruned, so only the listing is read.
    return files.filter(~F.col("path").rlike(r"/[._][^/]*$")).agg(F.max("_metadata.file_modification_time")).first()[0]


def newest_silver(spark: SparkSession, csv_path: str, schema: StructType) -> DataFrame:
    """The Parquet table beside a CSV table, of the same name, if it is not older; else the CSV table. Files may lie in folders."""
    beside = csv_path.removesuffix(".csv") + ".parquet"
    parquet, csv = changed_at(spark, beside), changed_at(spark, csv_path)
    if parquet is not None and csv is not None and parquet >= csv:
        return read_silver(spark, beside, schema)
    return read_silver(spark, csv_path, schema, "csv")


def write_silver(df: DataFrame, path: str, partition: str | None = None, csv_path: str | None = None) -> None:
    """Parquet, partitioned when asked (rows of a value lie together, a heavy value in several ranges), and optional CSV before it."""
    if csv_path:
        df.write.mode("overwrite").option("header", True).csv(csv_path)
    if partition:
        # The row's hash splits a heavy month over several ranges; small months stay together.
        df.repartitionByRange(F.col(partition), F.xxhash64(*df.columns)).write.mode("overwrite").partitionBy(partition).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_gold(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each non-empty named table to its folder; returns name -> path of what was written."""
    out = {}
    for name, df in tables.items():
        if not df.isEmpty():
            out[name] = f"{folder}/{name}"
            df.write.mode("overwrite").parquet(out[name])
    return out


def match_columns(columns, keywords: dict[str, list[str]]) -> dict[str, str]:
    """Target name -> first source column that contains one of its keywords (case-insensitive)."""
    found = {}
    for target, words in keywords.items():
        hit = next((x for w in words for x in columns if w.lower() in x.lower()), None)
        if hit:
            found[target] = hit
    return found


def customer_master(raw: DataFrame, keywords: dict[str, list[str]], defaults: dict, numeric=()) -> DataFrame:
    """Master data by keyword-matched columns with defaults for absent ones and safe number casts."""
    found = match_columns(raw.columns, keywords)
    def one(t):
        e = F.col(f"`{found[t]}`") if t in found else F.lit(defaults.get(t))
        if t in numeric:
            e = F.expr(f"try_cast(`{found[t]}` AS DOUBLE)") if t in found else e.cast("double")
        return F.coalesce(e, F.lit(defaults[t])).alias(t) if t in defaults else e.alias(t)
    return raw.select(*[one(t) for t in keywords])


AGING_ALIASES = {"under_180d": ["under_180d", "0-180", "180天以内"], "d180_to_1y": ["d180_to_1y", "180-365", "180天-1年"], "over_1y": ["over_1y", ">365", "1年以上"]}


def inventory_aging(raw: DataFrame, material: str = "material_id", aliases=AGING_ALIASES) -> DataFrame:
    """Material stock by age bucket: alias-matched columns, trimmed ids, unreadable numbers as 0."""
    def bucket(t):
        hit = next((a for a in aliases[t] if a in raw.columns), None)
        return (F.coalesce(F.expr(f"try_cast(`{hit}` AS DOUBLE)"), F.lit(0.0)) if hit else F.lit(0.0)).alias(t)
    return raw.select(F.trim(F.col(material).cast("string")).alias("material_id"), *[bucket(t) for t in aliases])


def bom(raw: DataFrame, material: str, product: str) -> DataFrame:
    """Distinct (material, finished good) pairs with trimmed ids."""
    return raw.select(F.trim(F.col(material).cast("string")).alias("material_id"), F.trim(F.col(product).cast("string")).alias("product_id")).dropDuplicates()


def map_fields(raw: DataFrame, mapping: dict[str, str], critical, optional=()) -> DataFrame:
    """Rename by the map, add absent optional columns as NULL, fail on absent critical ones."""
    df = raw.withColumnsRenamed({k: v for k, v in mapping.items() if k in raw.columns})
    gone = [x for x in critical if x not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df.withColumns({x: F.lit(None).cast("string") for x in optional if x not in df.columns}) if optional else df


def long_history(frozen: DataFrame, current: DataFrame, keys, value: str = "revenue") -> DataFrame:
    """Frozen history and current months in one series."""
    cols = [*keys, value]
    return frozen.select(*cols).unionByName(current.select(*cols)).groupBy(*keys).agg(F.sum(value).alias(value))
