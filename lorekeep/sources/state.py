"""Tables that runs read and replace: each version is a folder of its own, and a pointer names the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lorekeep.sources import files

#: Versions that stay: the current one, and the one before for those that are still reading it.
KEPT = 2


def _current(spark: SparkSession, path: str) -> list[str]:
    """The versions that the pointer names, the current one first; none if there is no pointer."""
    fs, pointer = files.at(spark, f"{path}/current.txt")
    if not fs.exists(pointer):
        return []
    stream = fs.open(pointer)
    try:
        named = bytes(stream.readAllBytes()).decode().split()
    finally:
        stream.close()
    if not named or not fs.exists(files.at(spark, f"{path}/v={named[0]}/_SUCCESS")[1]):
        raise ValueError(f"{path}/current.txt names no complete version")
    return named


def save(df: DataFrame, path: str) -> str:
    """Write a new version, then swap the pointer in one step: readers see the old version or the new one, never a mixture
    and never nothing. Versions before the last ones go."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/v={version}")
    named = [version, *_current(spark, path)]
    files.replace(spark, f"{path}/current.txt", ["\n".join(named[:KEPT]).encode()])
    for old in named[KEPT:]:
        fs, folder = files.at(spark, f"{path}/v={old}")
        fs.delete(folder, True)
    return version


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version; without a pointer an empty table. A pointer that names no complete version is an error."""
    named = _current(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={named[0]}") if named else spark.createDataFrame([], schema)
