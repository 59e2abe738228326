"""Sources and sinks of records: CSV, JSON, JDBC, bundles of tables in one text, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, sep=sep)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_database(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, properties: dict | None = None) -> DataFrame:
    """A database table in ranges of a numeric column, so that many tasks read it."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=partitions, properties=properties or {})


def append(df: DataFrame, path: str, day_of: str | None = None) -> None:
    """Appends records, by day where a timestamp column is named."""
    out = df.withColumn("day", F.to_date(day_of)) if day_of else df
    writer = out.write.mode("append")
    (writer.partitionBy("day") if day_of else writer).parquet(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Rows of bundles: `csv_header:table:a,b` names the columns of the file's `csv_row:table:1,2` lines.

    Returns file, table, names, values, where values are strings; quoted ones may hold commas and escaped quotes. Lines
    are read in splits of the files, and headers are a side table that is joined by file and table; a row without a
    header has null names. Of several headers of a table in one file the greatest text counts.
    """
    part = F.split("value", ":", 3)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), part[0].alias("kind"), part[1].alias("table"), part[2].alias("text"))
    headers = lines.where("kind = 'csv_header'").groupBy("file", "table").agg(F.split(F.max("text"), ",").alias("names"))
    values = F.transform(F.regexp_extract_all(F.concat("text", F.lit(",")), F.lit(r'("(?:[^"\\]|\\.)*"|[^,]*),'), 1), lambda v: F.regexp_replace(F.regexp_replace(v, r'^"|"$', ""), r"\\(.)", "$1"))
    rows = lines.where("kind = 'csv_row'").select("file", "table", values.alias("values"))
    return rows.join(headers, ["file", "table"], "left").select("file", "table", "names", "values")
