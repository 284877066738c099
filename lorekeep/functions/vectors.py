"""Vector expressions over ARRAY<DOUBLE>, and the deterministic embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Dimensions of the built-in embedder.
HASH_DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f uses it: the optimiser may copy an expression into every
    place of its use, but not what a lambda is given."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def l2_normalize(v: Column) -> Column:
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    return bind(v, lambda x: bind(F.coalesce(F.nullif(norm(x), F.lit(0.0)), F.lit(1.0)), lambda n: F.transform(x, lambda y: y / n)))


def as_double(v: Column) -> Column:
    return F.transform(v.cast("array<double>"), lambda x: x)


def hash_embed(rows: DataFrame, keys: list[str], text: str, dim: int = HASH_DIM) -> DataFrame:
    """``keys`` and vec: normalised counts of hashed tokens. All within the row: tokens become one character each, of
    which the row's string is counted. A row without tokens has the zero vector."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    cell = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 31, 2), 16, 10).cast("int") % dim
    marks = F.coalesce(F.array_join(F.transform(tokens, lambda t: F.char(cell(t) + 48)), ""), F.lit(""))
    count = lambda s, k: (F.length(s) - F.length(F.replace(s, F.lit(chr(48 + k)), F.lit("")))).cast("double")
    return rows.select(*keys, l2_normalize(bind(marks, lambda s: F.array(*[count(s, k) for k in range(dim)]))).alias("vec"))


def injected(embed: Callable[[list[str]], np.ndarray], prefix: str = "") -> Callable[[DataFrame, list[str], str], DataFrame]:
    """An embedder from a function that takes texts, each with ``prefix`` before it, and gives a matrix: texts reach it in
    batches, and its rows are normalised. It must be one that Python workers can load."""

    def run(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
        source = rows.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t"))

        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np
            import pyarrow as pa

            for batch in found:
                x = np.asarray(embed([prefix + t for t in batch.column("_t").to_pylist()]), np.float64).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(norm > 0, norm, 1.0)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], [*keys, "vec"])

        schema = StructType([*(source.schema[k] for k in keys), StructField("vec", ArrayType(DoubleType()))])
        return source.mapInArrow(batches, schema)

    return run


def mean_vector(vec: Column, dim: int) -> Column:
    """Element-wise mean as one aggregate, combined before the shuffle: no row for each element."""
    return F.array(*[F.avg(F.get(vec, F.lit(k))) for k in range(dim)])
