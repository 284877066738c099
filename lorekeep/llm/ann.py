"""Operator 5: nearest neighbours by multiprobe p-stable hashing.

Inner products become distances: with M the largest norm, every row gets the coordinate sqrt(M^2 - |x|^2) and is divided
by M, a query by its own norm, so that all lie on the unit sphere and the nearest point to a query is the one of largest
inner product. TABLES tables hash rows by projections on 2-stable (Gaussian) directions, cut into cells.

A query visits its own bucket and perturbed ones by estimated success. The projection of a point at cosine c to the
query is normal with mean c times the query's own projection and variance 1 - c^2, whatever the data; so each bucket has
a probability of holding a neighbour, and the buckets come in the order of that probability over the share of rows that
they hold, down to a threshold. c, the cells' shares, the number of hashes and the threshold are fitted on bounded samples
(SAMPLE queries with their true neighbours among all rows, ROWS rows): of the numbers of hashes in HASHES, the one of
least work at a recall of RECALL on the sample. Every row is indexed. Candidates of all tables are merged and ranked by
exact products.

Equal vectors form one class that keeps its smallest ids, as many as a result can show: a vector that a third of all
rows share is hashed and compared once, and no result changes. Rows lie in groups by the first cells of their buckets,
and a query goes to the groups that can hold a bucket of enough success, once to each; a group of any size is dealt over
blocks of BLOCK_ROWS rows, past each of which its queries stream.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part
as query or candidate; with fewer candidates than asked all are returned; queries that found fewer than that (their
buckets hold too few rows) are searched again among all rows; ties among what is found go to the smaller vec_id, however
many tie; rows equal in vec_id and vector count once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import mix64, read, stash
from lorekeep.llm.words import spread

TABLES = 5
#: Numbers of hashes that fit() tries, until the work grows.
HASHES = (4, 6, 8, 10, 12, 16, 20, 24, 28, 32)
#: A cell's width, in standard deviations of a projection, and the cells on either side of zero; the outermost are endless.
CELL, FAR = 2.5, 3
RECALL = 0.94
#: Queries, and rows, of the samples that fit the tables.
SAMPLE, ROWS = 200, 10_000
BLOCK_ROWS = 65_536
#: From this share of a block on, a query's products are taken with the whole block at once.
DENSE = 1 / 8


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (a rational approximation)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


@dataclass
class Tables:
    directions: np.ndarray  # TABLES x (dim + 1) x hashes
    offsets: np.ndarray  # TABLES x hashes
    norm: float
    cosine: float
    shares: np.ndarray  # TABLES x hashes x cells: logarithm of the share of rows
    threshold: float = -math.inf

    @staticmethod
    def draw(rows: np.ndarray, norm: float, cosine: float, hashes: int, seed: int = 3) -> Tables:
        """Random directions and offsets, and the shares of the sample ``rows``."""
        rng = np.random.default_rng(seed)
        cells = 2 * FAR + 1
        t = Tables(rng.standard_normal((TABLES, rows.shape[1] + 1, hashes)), rng.uniform(0, CELL, (TABLES, hashes)), norm, cosine, np.zeros((TABLES, hashes, cells)))
        flat = np.arange(TABLES * hashes).reshape(TABLES, hashes) * cells + t.cells(rows)
        count = np.bincount(flat.ravel(), minlength=TABLES * hashes * cells).reshape(TABLES, hashes, cells)
        return replace(t, shares=np.log((count + 0.5) / (len(rows) + 0.5 * cells)))

    def _projections(self, unit: np.ndarray, last: np.ndarray) -> np.ndarray:
        full = np.concatenate([unit, last[:, None]], 1)
        return np.stack([full @ d for d in self.directions], 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cells of rows, counted from 0: rows x TABLES x hashes."""
        unit = x / self.norm
        p = self._projections(unit, np.sqrt(np.maximum(1 - (unit**2).sum(1), 0)))
        return (np.clip(np.floor((p + self.offsets) / CELL), -FAR, FAR) + FAR).astype(np.int64)

    def gains(self, x: np.ndarray) -> np.ndarray:
        """For queries, the logarithm of each cell's probability of a neighbour over its share of rows: queries x TABLES x
        hashes x cells. A bucket's success is the sum over its cells."""
        p = self._projections(x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x)))
        edges = np.arange(-FAR, FAR + 2) * CELL
        edges[0], edges[-1] = -100, 100
        at = (edges - self.offsets[..., None] - self.cosine * p[..., None]) / math.sqrt(1 - self.cosine**2)
        return np.log(np.maximum(np.diff(_phi(at), axis=-1), 1e-9)) - self.shares

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        """64-bit keys of buckets (... x hashes)."""
        h = np.zeros(cells.shape[:-1], np.uint64)
        for k in range(cells.shape[-1]):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.uint64) + np.uint64(1))
        return h

    def entropy(self) -> np.ndarray:
        """How much, on average over the tables, the first, the first two ... hashes part the rows (in nats)."""
        p = np.exp(self.shares)
        return np.cumsum(-(p * self.shares).sum(axis=2).mean(axis=0))

    def heads(self, gain: np.ndarray, prefix: int) -> np.ndarray:
        """The first ``prefix`` cells of all buckets whose success can reach the threshold (heads x prefix), for one query
        in one table (``gain``: hashes x cells)."""
        rest = np.append(np.cumsum(gain.max(axis=1)[::-1])[::-1], 0.0)  # the most that the hashes from k on can add
        cells, total = np.zeros((1, 0), np.int64), np.zeros(1)
        for k in range(prefix):
            total = (total[:, None] + gain[k]).ravel()
            cells = np.concatenate([np.repeat(cells, gain.shape[1], axis=0), np.tile(np.arange(gain.shape[1]), len(cells))[:, None]], 1)
            can = total + rest[k + 1] >= self.threshold
            cells, total = cells[can], total[can]
        return cells


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products whose sums run in the same order for each row, so that equal vectors score alike."""
    return (x * q).sum(axis=1)


def longest(x: np.ndarray) -> float:
    return math.sqrt((x**2).sum(1).max(initial=0.0))


def best_of(near: np.ndarray, rough: np.ndarray, x: np.ndarray, norm: float, q: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows ``near`` of x (of ``norm`` at most), whose products with q are ``rough`` but for rounding, the k best by
    exact product, then by ``low`` (a class's least id), and their products. All that may tie with the k-th are compared."""
    if len(near) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = near[rough >= least - 1e-12 * norm * np.linalg.norm(q)]
    s = exact(x[near], q)
    best = np.lexsort((low[near], -s))[:k]
    return near[best], s[best]


def valid_rows(table: DataFrame) -> DataFrame:
    """vec_id, vec, cls of the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    # 0.0 and -0.0 are one value
    valid = table.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).select("vec_id", F.transform(vec, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("vec"))
    # two hashes make a class, so that different vectors don't meet
    return valid.withColumn("cls", F.xxhash64(F.xxhash64("vec"), F.xxhash64(F.lit(1), F.reverse("vec"))))


def vectors(table: DataFrame, keep: int) -> tuple[DataFrame, int]:
    """Distinct valid vectors (cls, vec, ids: the ``keep`` smallest vec_ids of those equal), and their dimension."""
    valid = valid_rows(table)
    sizes = valid.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = sizes.d if sizes else 0
    nth = F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))
    least = valid.where(F.size("vec") == dim).distinct().withColumn("_nth", nth).where(F.col("_nth") <= keep)
    return least.groupBy("cls").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids")), dim


def true_neighbours(classes: DataFrame, queries: np.ndarray, k: int, dim: int) -> dict[int, np.ndarray]:
    """The k best classes' vectors of each of a few queries (by product, then least id), over all rows, in blocks."""
    shared = classes.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best_s, best_i, best_v = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0, dim))
        for batch in batches:
            vec, low = _matrix(batch.column("vec"), dim), batch.column("low").to_numpy(zero_copy_only=False)
            for a in range(0, len(vec), 2048):
                x, ids = vec[a : a + 2048], low[a : a + 2048]
                rough, norm = q @ x.T, longest(x)
                found = [best_of(np.arange(len(x)), rough[j], x, norm, q[j], ids, k) for j in range(len(q))]
                at = np.array([f[0] for f in found])
                s, i, v = np.concatenate([best_s, np.array([f[1] for f in found])], 1), np.concatenate([best_i, ids[at]], 1), np.concatenate([best_v, x[at]], 1)
                top = np.array([np.lexsort((b, -a))[:k] for a, b in zip(s, i, strict=True)])
                best_s, best_i, best_v = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1), np.take_along_axis(v, top[:, :, None], 1)
        rows = np.repeat(np.arange(len(q)), best_s.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(best_s.ravel()), pa.array(best_i.ravel()), pa.array(list(best_v.reshape(-1, dim)), pa.list_(pa.float64()))], ["q", "score", "low", "vec"])

    found = classes.select("vec", F.col("ids")[0].alias("low")).mapInArrow(run, "q long, score double, low long, vec array<double>")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "low"))
    out: dict[int, list] = {}
    for r in found.withColumn("_nth", nth).where(F.col("_nth") <= k).orderBy("q", "_nth").select("q", "vec").collect():
        out.setdefault(r.q, []).append(r.vec)
    return {q: np.array(v) for q, v in out.items()}


def sampled(vectors: DataFrame, most: int) -> np.ndarray:
    """The vectors of ``most`` classes at most, by hash."""
    found = vectors.orderBy(F.xxhash64("cls"), "cls").limit(most).select("vec").toArrow().column("vec").combine_chunks()
    return _matrix(found, len(found[0]))


def fit(classes: DataFrame, queries: DataFrame, k: int, dim: int) -> tuple[Tables, float]:
    """Tables fitted on samples, and the share of rows that a query visits, as the samples tell."""
    norm = classes.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).alias("n")).first()["n"]
    asked, rows, n = sampled(queries, SAMPLE), sampled(classes, ROWS), classes.count()
    truth = true_neighbours(classes, asked, k + 1, dim)  # a query's own class is the first, or one of the first
    near = [truth[j] for j in range(len(asked))]
    cosine = np.concatenate([(x @ q / (norm * np.linalg.norm(q)))[min(1, len(x) - 1) :] for q, x in zip(asked, near, strict=True)])
    typical = float(np.clip(np.median(cosine), 0.05, 0.95))
    best: tuple[float, float, Tables] | None = None
    for hashes in HASHES:
        tables = Tables.draw(rows, norm, typical, hashes)
        gain, own = tables.gains(asked), tables.cells(rows)
        wanted = [tables.cells(x) for x in near]

        def success(j: int, cells: np.ndarray) -> np.ndarray:
            """Of the bucket that is best for query j, over the tables."""
            return gain[j][np.arange(TABLES)[:, None], np.arange(hashes), cells].sum(axis=2).max(axis=1)  # noqa: B023

        reached = np.sort(np.concatenate([success(j, c) for j, c in enumerate(wanted)]))
        tables.threshold = float(reached[math.floor((1 - RECALL) * len(reached))]) - 1e-9
        visited = float(np.mean([(success(j, own) >= tables.threshold).mean() for j in range(0, len(asked), 4)]))
        buckets = min(1.0, math.exp(min(700.0, tables.entropy()[-1])) / n)  # a row, about
        work = TABLES * hashes * buckets + visited * dim
        if best and work > best[0]:
            break
        best = work, visited, tables
    return best[2], best[1]


def candidates(classes: DataFrame, queries: DataFrame, tables: Tables | None, k: int, dim: int) -> DataFrame:
    """(query, cls, low, score): of each block the best k classes for each query class that visits it; without ``tables``,
    each query visits all rows."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(tables)
    prefix = 0
    if tables:  # groups of a block, on average: so many hashes as part the rows that often
        often = math.log(max(1.0, classes.count() / BLOCK_ROWS))
        prefix = int(np.searchsorted(np.append(0.0, tables.entropy()[:-1]), often))

    def groups(heads: np.ndarray, t: int) -> np.ndarray:
        return mix64(Tables.keys(heads) + np.uint64(t)).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), dim)
            cells = shared.value.cells(x) if tables else np.zeros((len(x), 1, 0), np.int64)
            for t in range(cells.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(groups(cells[:, t, :prefix], t)), pa.array(np.full(len(x), t, np.int32)), *(batch.column(c) for c in ("cls", "low", "vec"))], ["grp", "tab", "cls", "low", "vec"])

    vec = [F.col("cls"), F.col("ids")[0].alias("low"), F.col("vec")]
    placed = classes.select(*vec).mapInArrow(place, "grp long, tab int, cls long, low long, vec array<double>")
    # a group that is larger than a block has several: its rows are dealt by their hash. Only those reach the driver
    sizes = placed.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).collect()
    parts = spark.sparkContext.broadcast({r.grp: -(-r.n // BLOCK_ROWS) for r in sizes})
    names = ["grp", "part", "kind", "tab", "cls", "low", "vec"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = np.array([parts.value.get(g, 1) for g in batch.column("grp").to_pylist()], np.uint64)
            part = (mix64(batch.column("cls").to_numpy(zero_copy_only=False).astype(np.uint64)) % np.maximum(many, np.uint64(1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(part), pa.array(np.zeros(len(part), np.int32)), *(batch.column(c) for c in names[3:])], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                gain = shared.value.gains(_matrix(batch.column("vec"), dim)) if tables else np.zeros((batch.num_rows, 1, 0, 0))
                out = []
                for i, t in itertools.product(range(batch.num_rows), range(gain.shape[1])):
                    heads = shared.value.heads(gain[i, t], prefix) if prefix else np.zeros((1, 0), np.int64)
                    out += [(g, p, t, i) for g in groups(heads, t).tolist() for p in range(parts.value.get(g, 1))]
                grp, part, tab, row = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4
                own = [batch.column(c).take(pa.array(row)) for c in ("cls", "low", "vec")]
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(part.astype(np.int32)), pa.array(np.ones(len(grp), np.int32)), pa.array(tab.astype(np.int32)), *own], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, block = None, [], None
        for batch in batches:
            grp, part, kind, tab, cls, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in names[:6])
            x = _matrix(batch.column("vec"), dim)
            change = np.flatnonzero((np.diff(grp) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            found: tuple[list, list, list, list] = ([], [], [], [])
            for a, b in itertools.pairwise([0, *change.tolist(), len(grp)]):
                if a == b:
                    continue
                if (grp[a], part[a]) != at:
                    at, rows, block = (grp[a], part[a]), [], None
                if kind[a] == 0:
                    rows.append((cls[a:b], low[a:b], x[a:b]))
                elif rows:
                    block = block or Block(*(np.concatenate(p) for p in zip(*rows, strict=True)), shared.value, int(tab[a]))
                    for c in range(a, b, 32):
                        for i, near, score in block.search(x[c : min(c + 32, b)], k):
                            found[0].append(np.full(len(near), cls[c + i]))
                            found[1].append(block.cls[near])
                            found[2].append(block.low[near])
                            found[3].append(score)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in found], ["query", "cls", "low", "score"])

    kinds = "grp long, part int, kind int, tab int, cls long, low long, vec array<double>"
    both = placed.mapInArrow(deal, kinds).union(queries.select(*vec).mapInArrow(ask, kinds))
    blocks = both.repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")
    return blocks.mapInArrow(search, "query long, cls long, low long, score double")


class Block:
    """Rows of one group of a table, bucket by bucket."""

    def __init__(self, cls: np.ndarray, low: np.ndarray, x: np.ndarray, tables: Tables | None, t: int):
        self.tables, self.t = tables, t
        cells = tables.cells(x)[:, t] if tables else np.zeros((len(x), 0), np.int64)
        order = np.argsort(Tables.keys(cells), kind="stable")
        self.cls, self.low, self.x, cells = cls[order], low[order], x[order], cells[order]
        self.begin = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1)))
        self.size = np.diff(np.append(self.begin, len(x)))
        self.cells = cells[self.begin]  # of each bucket
        self.norm = longest(x)

    def search(self, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place in q, rows found, their products)."""
        success = np.zeros((len(q), len(self.begin)))
        if self.tables:
            gain = self.tables.gains(q)[:, self.t]
            for h in range(self.cells.shape[1]):
                success += gain[:, h][:, self.cells[:, h]]
        visit = success >= (self.tables.threshold if self.tables else 0)
        dense = visit @ self.size > DENSE * len(self.x)
        rough = np.zeros((len(q), len(self.x)))
        rough[dense] = q[dense] @ self.x.T
        for i in range(len(q)):
            near = spread(self.begin[visit[i]], self.size[visit[i]])
            if len(near):
                yield i, *best_of(near, rough[i, near] if dense[i] else self.x[near] @ q[i], self.x, self.norm, q[i], self.low, k)


def search(table: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each row that fulfils ``is_query``
    (a condition on vec_id), the row itself aside."""
    out = "query_id long, rank int, vec_id long, score double"
    found, dim = vectors(table, k + 1)
    if not dim:
        return table.sparkSession.createDataFrame([], out)
    classes = stash(found, "classes")
    # every row that asks, with its class: rows of one vector share one search
    rows = valid_rows(table).where(is_query).select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query")).distinct()
    rows = stash(rows.join(classes.select(F.col("cls").alias("query")), "query", "left_semi"), "queries")
    queries = stash(classes.join(rows.select(F.col("query").alias("cls")).distinct(), "cls", "left_semi"), "asked")
    if not queries.limit(1).count():
        return table.sparkSession.createDataFrame([], out)
    tables, _ = fit(classes, queries, k, dim)
    got = stash(best_rows(stash(candidates(classes, queries, tables, k + 1, dim), "found"), classes, rows, k), "nearest")
    # those that found too few look everywhere
    full = got.where(F.col("rank") == k).select("query_id")
    short = rows.join(full, "query_id", "left_anti")
    if short.limit(1).count():
        again = classes.join(short.select(F.col("query").alias("cls")).distinct(), "cls", "left_semi")
        more = best_rows(candidates(classes, again, None, k + 1, dim), classes, short, k)
        got = got.join(short, "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(more)
    return got


def best_rows(found: DataFrame, classes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """From classes to rows: merge what tables and blocks found, spread the classes' ids, leave out the row itself."""
    merged = found.groupBy("query", "cls", "low").agg(F.max("score").alias("score"))
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    top = merged.withColumn("_nth", F.row_number().over(by_class)).where(F.col("_nth") <= k + 1)
    ids = top.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = ids.withColumn("_nth", F.row_number().over(by_id)).where(F.col("_nth") <= k + 1)
    spread = rows.join(lists, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spread.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
