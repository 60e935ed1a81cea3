"""Edge and vertex scans, and sinks.

Text files have one record per line. Schemas are explicit and malformed records fail the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED_WEIGHT = 3.0


def read_edges(spark: SparkSession, path: str, *, ids: str = "string", comment: str | None = "#", weight: float | None = None, sep: str = "\t") -> DataFrame:
    """src, dst (strings) and, with a weight, value. ids="long" parses the ids and writes them back, so 007 is 7."""
    reader = spark.read.schema(f"src {ids}, dst {ids}").option("sep", sep).option("mode", "FAILFAST")
    if comment:
        reader = reader.option("comment", comment)
    edges = reader.csv(path).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return edges if weight is None else edges.withColumn("value", F.lit(float(weight)))


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """id (string), value (long) from comma-separated lines; lines that begin with # are comments."""
    return spark.read.schema("id string, value long").option("comment", "#").option("mode", "FAILFAST").csv(path)


def inline_edges(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Edges from pairs, or triples with a weight."""
    schema = "src string, dst string, value double" if rows and len(rows[0]) == 3 else "src string, dst string"
    return spark.createDataFrame([(str(r[0]), str(r[1]), *map(float, r[2:])) for r in rows], schema)


def write_rows(df: DataFrame, path: str, sep: str = ",") -> None:
    """One line per row, fields joined by sep without quotes. A map column is written as {k=v, ...} by its keys' order."""
    fields = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("map<"):
            entries = F.array_sort(F.map_entries(c))
            c = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ", "), F.lit("}"))
        fields.append(F.coalesce(c.cast("string"), F.lit("null")))
    df.select(F.concat_ws(sep, *fields).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
