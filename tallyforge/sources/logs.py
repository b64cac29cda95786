"""JSON-lines logs: folder walks, and three ways to treat lines that do not parse.

All readers go through Spark's sources, so any path that Spark reads will do; headers() uses
the source of logscan where it reaches the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import logscan


def lines(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, line) of every line of the files below a folder, in no order."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def parsed(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.jsonl") -> DataFrame:
    """(path, line, row): row is null for blank and malformed lines."""
    rows = lines(spark, folder, glob).where(F.trim("line") != "")
    ok = F.try_parse_json("line").isNotNull()
    return rows.withColumn("row", F.when(ok, F.from_json("line", schema)))


def read_skipping(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.jsonl") -> DataFrame:
    """Rows of the lines that parse; the others are left out."""
    return parsed(spark, folder, schema, glob).where("row is not null").select("path", "row.*")


def malformed_counts(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.jsonl") -> DataFrame:
    """(path, lines, malformed) per file."""
    return parsed(spark, folder, schema, glob).groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("row").isNull()).alias("malformed"))


def read_strict(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.jsonl") -> DataFrame:
    """(path, at, row.*) with a cut last line left out; any other bad line raises.

    A last line is cut when its file does not end in a line end. Files are read whole:
    a record may not be larger than a task's memory.
    """
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    each = whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("at", "line"), F.size(F.split("value", "\n")).alias("n"))
    last = F.col("at") == F.col("n") - 1
    ok = F.try_parse_json("line").isNotNull()
    rows = each.where((F.trim("line") != "") & ~(last & ~ok))
    problem = F.concat(F.lit("bad line "), F.col("at").cast("string"), F.lit(" of "), F.col("path"))
    checked = F.when(ok, F.col("line")).otherwise(F.raise_error(problem).cast("string"))
    return rows.select("path", "at", F.from_json(checked, schema).alias("row")).select("path", "at", "row.*")


def headers(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.jsonl") -> DataFrame:
    """The first line of each file, parsed; files with a bad first line are left out. A file
    is read up to its first line end, except in stores that only Spark's readers reach,
    where it is read whole."""
    if glob.startswith("*.") and logscan.reachable(folder):
        first = logscan.scan(spark, folder, glob[1:], "first").select("path", "line")
    else:
        whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
        first = whole.select(F.col("_metadata.file_path").alias("path"), F.substring_index("value", "\n", 1).alias("line"))
    return first.where(F.try_parse_json("line").isNotNull()).select("path", F.from_json("line", schema).alias("row")).select("path", "row.*")


def newer_than(files: DataFrame, since: str) -> DataFrame:
    """Rows whose file name carries a time (2024-05-01T08-25-07-381Z) at or after `since`."""
    name = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})-(\d{3})Z", 0)
    at = F.to_timestamp(F.regexp_replace(name, r"T(\d{2})-(\d{2})-(\d{2})-(\d{3})Z", "T$1:$2:$3.$4Z"))
    return files.where(at >= F.to_timestamp(F.lit(since)))


def migrated(entries: DataFrame, steps: list) -> DataFrame:
    """Entries brought to the newest version: steps[i] maps a frame of version i + 1
    (columns and a `version`) to version i + 2."""
    out = entries
    for step in steps:
        out = step(out)
    return out


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(name, labels, value) of a text exposition of metrics; comments are left out."""
    row = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?\s+([-+0-9.eE]+|NaN|[-+]?Inf)"
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & F.rlike("value", F.lit(row)))
    part = lambda i: F.regexp_extract("value", row, i)
    return raw.select(part(1).alias("name"), part(2).alias("labels"), part(3).cast("double").alias("value"))


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    """One folder per split; refuses to overwrite."""
    df.write.mode("errorifexists").partitionBy(column).json(path)


def manifest(df: DataFrame, key: str, column: str) -> DataFrame:
    """(column, rows, sha256): a checksum per part that does not depend on row order:
    the hash of the sorted hashes of its rows, added up in 16 digit sums."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))).cast("binary"), 256)
    word = lambda i: F.conv(F.substring(h, 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(word(i)).cast("string") for i in range(4)]
    return df.groupBy(column).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", *sums).cast("binary"), 256).alias("sha256"))
