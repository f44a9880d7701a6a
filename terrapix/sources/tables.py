"""Scans and sinks: pixel tables in Parquet, observation tables in delimited text, metadata in grouped text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_pixels(spark: SparkSession, path: str, bands: Sequence[str] | None = None) -> DataFrame:
    """A stored raster: row, col and bands; only the bands asked for are read."""
    df = spark.read.parquet(path)
    return df if bands is None else df.select("row", "col", *bands)


def write_pixels(df: DataFrame, path: str, tile: int = 512, dtype: str = "float") -> None:
    """One folder for each tile, sorted within, so that bounds prune files and row groups."""
    from ..operators.grid import assign_tiles

    bands = [c for c, t in df.dtypes if c not in ("row", "col") and t in ("double", "float")]
    cast = assign_tiles(df.withColumns({b: F.col(b).cast(dtype) for b in bands}), tile)
    cast.repartition("tile_i", "tile_j").sortWithinPartitions("row", "col").write.partitionBy("tile_i", "tile_j").option("compression", "zstd").parquet(path)


def stack_bands(parts: dict[str, DataFrame]) -> DataFrame:
    """Single-band rasters (row, col, value) as one table, a column each; cells that miss a band are left out."""
    named = [df.select("row", "col", F.col("value").alias(b)) for b, df in parts.items()]
    return reduce(lambda a, b: a.join(b, ["row", "col"]), named)


def decimal_comma(c: Column) -> Column:
    """Text with a decimal comma as a number; null where it isn't one."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def scan_delimited(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], sep: str = ";", encoding: str = "ISO-8859-1", header: bool = True) -> DataFrame:
    """Delimited files as text columns plus the file each row comes from; the schema is stated, never inferred."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.option("sep", sep).option("encoding", encoding).option("header", header).schema(schema).csv(paths)
    return df.withColumn("file", F.input_file_name())


def points_from_xy(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds geometry, a struct of two doubles; rows without both coordinates get null."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.withColumn("geometry", F.when(ok, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))


def scan_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Stored polygons: poly_id, label and ring, closed or not; any other geometry is an error.

    type and ring columns are read from Parquet; ids are the stored ones, so that no order over all rows is needed.
    """
    df = spark.read.schema("poly_id long, label string, type string, ring array<struct<x:double,y:double>>").parquet(path)
    odd = df.where((F.col("type") != "Polygon") | (F.size("ring") < 3)).limit(1).collect()
    if odd:
        raise ValueError(f"not a polygon: {odd[0].poly_id}")
    return df.drop("type")


def grouped_metadata(lines: DataFrame) -> DataFrame:
    """(file, line, text) of 'BEGIN_GROUP = X / key = value; / END_GROUP' files as (file, grp, key, value, number).

    A window holds one file's lines. Quotes and the closing semicolon go; number is null where the value is none.
    """
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.regexp_extract("text", r"^\s*BEGIN_GROUP\s*=\s*(\S+)", 1)
    marked = lines.withColumn("mark", F.when(begin != "", begin).when(F.col("text").rlike(r"^\s*END_GROUP"), F.lit("")))
    inside = marked.withColumn("grp", F.last("mark", ignorenulls=True).over(w)).where("mark is null")
    key, value = F.regexp_extract("text", r"^\s*(\w+)\s*=", 1), F.regexp_extract("text", r"=\s*\"?([^\";]*)\"?\s*;?\s*$", 1)
    out = inside.select("file", F.coalesce(F.nullif(F.col("grp"), F.lit("")), F.lit("top")).alias("grp"), key.alias("key"), value.alias("value"))
    return out.where("key <> ''").withColumn("number", F.col("value").try_cast("double"))


def pair_tiles(paths: DataFrame, pattern: str = r"_(\d+_\d+)\.\w+$") -> DataFrame:
    """(kind, path) rows as one row for each suffix with the paths of every kind."""
    return paths.withColumn("suffix", F.regexp_extract("path", pattern, 1)).groupBy("suffix").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("kind", "path")))).alias("paths"))
