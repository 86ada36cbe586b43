"""Stores: JSON records with a place for corrupt ones, versioned tables with an active pointer, keyed upserts, content probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_records(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt): JSON files with a record a line; one that does not parse is set aside whole, with its file."""
    s = StructType(list(schema.fields)).add("_corrupt_record", StringType())
    lines = spark.read.text(path, recursiveFileLookup=True).filter(F.trim("value") != "").withColumn("file", F.input_file_name())
    raw = lines.withColumn("r", F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return raw.filter("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record"), raw.filter("r._corrupt_record IS NOT NULL").select("file", F.col("value").alias("record"))


def write_records(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def write_version(df: DataFrame, root: str, version: str) -> None:
    """An immutable version, then the pointer to it: readers see the old one until the new one is whole."""
    df.write.mode("errorifexists").parquet(f"{root}/versions/{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/active")


def read_active(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.parquet(f"{root}/active").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{root}/versions/{version}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Old and new rows with the last of each key in ``order``; a new row wins a tie."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(order.desc_nulls_last(), F.col("__new").desc())
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__new")


def unseen(df: DataFrame, content: Column, seen: DataFrame) -> DataFrame:
    """Rows whose content hash is not among seen.content_hash; their hash is added."""
    return df.withColumn("content_hash", F.sha2(content, 256)).join(seen.select("content_hash"), "content_hash", "left_anti")


def cache_key(*parts: Column) -> Column:
    """sha256 of a canonical JSON of the parts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
