"""Helpers shared by the training-data operators: tables, durable intermediate results, text rows."""

from __future__ import annotations

import math
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators define it.
SPACE = r"\x20\x09-\x0D"


#: Bytes of a batch that goes to a Python worker, about, where the session doesn't say otherwise: rows are of any length.
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Put this package's folder on the Python workers' path, where they share it (one machine, or a shared folder), and
    bound the batches that they get in bytes."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. The cluster names it; only on a single machine, where no name is
    set, a folder of this machine is used."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        path = f"file://{tempfile.gettempdir()}/lorekeep-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_FOLDERS: set[str] = set()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again. This cuts the lineage, and what was
    written outlives any executor. The application's tables go when it ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/lorekeep-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _FOLDERS.add(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_split(rows: DataFrame, found: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, an aggregate by ``on`` (whose first is a long). An aggregate's rows lie by its keys
    already, so a plain join gives them no exchange, and adaptive execution splits a hot key only between two exchanges.
    Both sides therefore join by the key's complement, to which neither is dealt yet."""
    key = on[0]
    turned = lambda d: d.withColumn(key, F.bitwise_not(F.col(key)))
    return turned(turned(rows).join(turned(found), on, how))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_text(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with another text, and n_chars, if there is such a column, to match where the text has changed."""
    out = {"text": text}
    if "n_chars" in df.columns:
        same = F.col("text").eqNullSafe(text)
        out["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(text)).cast(df.schema["n_chars"].dataType)
    return df.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


#: Values over which bounded_sample() deals its rows: the most frequent ones, so many at most.
MOST_VALUES = 1000


def bounded_sample(rows: DataFrame, by: str, key: Column, most: int, size: Column | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """About ``most`` of ``rows`` at most, and about ``most_bytes`` of ``size`` if given, as evenly over the values of ``by``
    as their numbers allow, by the hash of ``key``. A filter: no row is shuffled, and where all rows fit they are all there."""
    total = F.sum(F.lit(0) if size is None else size)
    found = rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("b")).agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0)).alias("s"))
    counts = sorted((r.n, r["b"], r.s) for r in found.orderBy(F.desc("n"), "b").limit(MOST_VALUES).collect())
    left, room, keep = most, most_bytes, F.lit(False)
    for k, (n, value, s) in enumerate(counts):
        share, space = min(n, left // (len(counts) - k)), room // (len(counts) - k)
        part = min(share / n, space / max(s, 1), 1.0)
        left, room = left - share, room - min(s, space)
        keep = keep | ((F.col(by) == F.lit(value)) & (F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) < F.lit(math.ceil(part * (1 << 40)))))
    return rows.where(keep)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser with good avalanche, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def by_size(batch: pa.RecordBatch, column: str, most: int = 3 << 20):
    """Slices of ``batch`` whose texts hold about ``most`` bytes at most (a longer text stands alone), so that
    memory doesn't follow the number of rows that Arrow puts in a batch."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
