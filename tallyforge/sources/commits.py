"""A log of commits below one folder, each published in two steps.

The rows of a commit are written first (`rows/seq=N`); its marker, with their number, is
written last (`markers`). A reader counts only rows whose commit has a marker, so a writer
that dies in between leaves nothing visible. There is a single writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "seq long, n long"


def publish(df: DataFrame, folder: str, seq: int, marked: bool = True) -> None:
    """Append one batch under one sequence number; marked=False stops after the first step.
    A sequence number that has rows already raises."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{folder}/rows/seq={seq}")
    if marked:
        n = spark.read.schema(df.schema).parquet(f"{folder}/rows/seq={seq}").agg(F.lit(seq).cast("long").alias("seq"), F.count("*").alias("n"))
        n.coalesce(1).write.mode("append").parquet(f"{folder}/markers")


def confirmed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of the commits that have their marker, with `seq`."""
    rows = spark.read.schema(f"{schema}, seq long").parquet(f"{folder}/rows")
    return rows.join(spark.read.schema(MARKER).parquet(f"{folder}/markers").select("seq"), "seq", "left_semi")


def state(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, rows, confirmed) of every commit: confirmed where a marker names as many rows."""
    rows = spark.read.parquet(f"{folder}/rows").groupBy(F.col("seq").cast("long").alias("seq")).agg(F.count("*").alias("rows"))
    marks = spark.read.schema(MARKER).parquet(f"{folder}/markers")
    return rows.join(marks, "seq", "left").select("seq", "rows", F.coalesce(F.col("n") == F.col("rows"), F.lit(False)).alias("confirmed"))
