"""Markdown notes, key-value files, instinct cards: what is read from and written to folders."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.config import DEFAULTS, Settings
from lorekeep.functions import text as T
from lorekeep.sources import files

NOTE = "file string, raw string, mtime timestamp"


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    return (
        spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "false").text(paths, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("mtime"))
    )


def scan_notes(spark: SparkSession, folder: str, s: Settings = DEFAULTS) -> DataFrame:
    """Top-level notes but the review file, and those of the sessions folder; deeper folders aren't read. As Spark reads no
    file whose name begins with an underscore, neither is a review file in the sessions folder (a deviation)."""
    parts = [_read_if_any(spark, folder, s.review_file, ""), _read_if_any(spark, f"{folder}/{s.sessions_dir}", None, f"{s.sessions_dir}/")]
    return parts[0].unionByName(parts[1])


def _read_if_any(spark: SparkSession, folder: str, without: str | None, prefix: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/*.md")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
        return spark.createDataFrame([], NOTE)
    found = _whole(spark, [folder])
    if without:
        found = found.where(F.col("name") != without)
    return found.select(F.concat(F.lit(prefix), "name").alias("file"), T.newlines(F.col("value")).alias("raw"), "mtime")


def scan_instincts(spark: SparkSession, folder: str) -> DataFrame:
    return _read_if_any(spark, folder, None, "")


def scan_key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a KEY=VALUE file; blank lines, comments and lines without ``=`` are skipped, the last value wins."""
    return key_values(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).withColumnRenamed("value", "line"))


def key_values(lines: DataFrame) -> DataFrame:
    """The same for (line_no, line)."""
    line = T.strip(F.col("line"))
    pair = F.split(line, "=", 2)
    kept = lines.where((line != "") & ~line.startswith("#") & line.contains("="))
    return kept.select("line_no", T.strip(pair[0]).alias("key"), T.strip(pair[1]).alias("value")).groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def write_notes(changed: DataFrame, folder: str) -> None:
    """Write (file, raw), each raw ending in a newline: executors write the texts, then each takes its note's place in one
    step. The driver sees names only."""
    spark = changed.sparkSession
    beside = f"{folder}/_new-{uuid.uuid4().hex}"
    changed.select("file", F.regexp_replace("raw", "\n\\z", "").alias("value")).write.partitionBy("file").text(beside)
    fs, new = files.at(spark, f"{beside}/*/part-*")
    for f in fs.globStatus(new) or []:
        name = unquote(f.getPath().getParent().getName().removeprefix("file="))
        files.move(spark, f.getPath().toString(), f"{folder}/{name}")
    fs.delete(files.at(spark, beside)[1], True)
