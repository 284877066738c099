"""Files that are replaced, appended to and listed through Hadoop's file systems, so that any store will do."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file, in one step also where the target is there already."""
    jvm = spark.sparkContext._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    _, old = at(spark, source)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(old, jvm.org.apache.hadoop.fs.Path(target), how)


def replace(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """Put a whole file, written part by part, in the place of an old one in one step: readers and crashes meet the old
    file or the new one."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, new = at(spark, beside)
    out = fs.create(new, True)
    for part in parts:
        out.write(bytearray(part))
    out.close()
    move(spark, beside, path)


def put_batch(rows: DataFrame, folder: str, batch: int) -> None:
    """Add a stream's batch to the Parquet table in ``folder``. A batch that runs again replaces what it left before."""
    spark = rows.sparkSession
    beside = f"{folder}/_batch-{batch}"
    rows.write.mode("overwrite").parquet(beside)
    fs, old = at(spark, f"{folder}/batch-{batch}-*")
    for f in fs.globStatus(old) or []:
        fs.delete(f.getPath(), False)
    for k, f in enumerate(fs.globStatus(at(spark, f"{beside}/part-*")[1]) or []):
        move(spark, f.getPath().toString(), f"{folder}/batch-{batch}-{k}.parquet")
    fs.delete(at(spark, beside)[1], True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files of a folder; 0 if there is none."""
    fs, p = at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def append_rotated(lines: DataFrame, folder: str, most_bytes: int, stamp: str) -> bool:
    """Append ``lines`` (value) to the log in ``folder``/current. A log that has reached ``most_bytes`` first moves to
    ``folder``/archive under a name with ``stamp``. Whether it moved."""
    spark = lines.sparkSession
    full = size(spark, f"{folder}/current") >= most_bytes
    if full:
        fs, old = at(spark, f"{folder}/current")
        _, archive = at(spark, f"{folder}/archive")
        fs.mkdirs(archive)
        if not fs.rename(old, at(spark, f"{folder}/archive/{stamp}-{uuid.uuid4().hex}")[1]):
            raise OSError(f"{folder}/current can't be moved")
    lines.select("value").write.mode("append").text(f"{folder}/current")
    return full


def read_rotated(spark: SparkSession, folder: str) -> DataFrame:
    """value, archived of all lines of such a log."""
    parts = [spark.createDataFrame([], "value string, archived boolean")]
    for name, archived in (("current", False), ("archive/*", True)):
        fs, p = at(spark, f"{folder}/{name}")
        if fs.globStatus(p):
            parts.append(spark.read.text(f"{folder}/{name}").select("value", F.lit(archived).alias("archived")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """path, size, mtime of the files that match ``pattern``; their contents aren't read."""
    found = spark.read.format("binaryFile").load(pattern)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
