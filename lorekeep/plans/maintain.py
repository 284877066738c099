"""Jobs over a folder of notes: index, recall, review, links, and all of them in order.

``store`` is a folder for the engine's tables. Every job reads the tables that the one before it has written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.config import DEFAULTS, Settings
from lorekeep.functions import vectors as V
from lorekeep.operators import notes as N
from lorekeep.sources import notes as S
from lorekeep.sources import files, lock, state

FILES = "file string, hash string, mtime timestamp, model string"
CHUNKS = "file string, heading string, text string, ord int, vec array<double>, reused boolean"
MODEL = "hash64"


def load_index(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """The saved index; empty tables if there is none."""
    return state.load(spark, f"{store}/files", FILES), state.load(spark, f"{store}/chunks", CHUNKS)


def save_index(files: DataFrame, chunks: DataFrame, store: str) -> None:
    """Chunks first: a file counts as indexed only once its chunks are there."""
    state.save(chunks, f"{store}/chunks")
    state.save(files, f"{store}/files")


def index(spark: SparkSession, folder: str, store: str, embed=V.hash_embed, model: str = MODEL, s: Settings = DEFAULTS) -> DataFrame:
    """Bring the index up to date; its statistics."""
    files, chunks = N.build_index(S.scan_notes(spark, folder, s), *load_index(spark, store), model, embed, s=s)
    save_index(files, chunks, store)
    return N.index_stats(*load_index(spark, store))


def recall(spark: SparkSession, store: str, queries: list[str], k: int | None = None, embed=V.hash_embed, s: Settings = DEFAULTS) -> DataFrame:
    """query, rank, score, file, heading, text of the best chunks for each query."""
    asked = embed(spark.createDataFrame(list(enumerate(queries)), "query long, q string"), ["query"], "q").withColumnRenamed("vec", "qvec")
    return N.recall(load_index(spark, store)[1], asked, k, s).select("query", "rank", "score", "file", "heading", "text")


def _vectors(spark: SparkSession, store: str) -> DataFrame:
    return N.file_vectors(load_index(spark, store)[1], V.HASH_DIM, only_top_level=True, centered=True)


def lifecycle(spark: SparkSession, folder: str, store: str, now: Column, s: Settings = DEFAULTS) -> DataFrame:
    """The review's lines (section, pos, line)."""
    return N.review(N.stale(S.scan_notes(spark, folder, s), now, s=s), N.dup_pairs(_vectors(spark, store), s=s), s)


def graph(spark: SparkSession, folder: str, store: str, s: Settings = DEFAULTS) -> DataFrame:
    """The notes' graph for other programs: file, target, score of each edge, without writing to the notes."""
    return N.links(_vectors(spark, store), N.slugs(S.scan_notes(spark, folder, s)), s=s).select("file", "target", "score")


def link(spark: SparkSession, folder: str, store: str, s: Settings = DEFAULTS) -> dict[str, int]:
    """Write the related notes into each note whose text changes by it."""
    found = S.scan_notes(spark, folder, s)
    rows = N.apply_links(found, N.links(_vectors(spark, store), N.slugs(found), s=s), s)
    counts = rows.agg(F.count("*").alias("linked_files"), F.count_if("changed").alias("written")).first()
    S.write_notes(rows.where("changed").select("file", F.col("new_raw").alias("raw")), folder)
    return counts.asDict()


def maintain(spark: SparkSession, folder: str, store: str, now: Column, s: Settings = DEFAULTS) -> dict:
    """Index, review, links, in this order; the review goes to its file in the folder. Nothing is done, and the result is
    empty, while the store's switch is set or another run is at it."""
    with lock.exclusive(spark, store, s.lock_minutes) as free:
        return _maintain(spark, folder, store, now, s) if free else {}


def _maintain(spark: SparkSession, folder: str, store: str, now: Column, s: Settings) -> dict:
    stats = index(spark, folder, store, s=s).first().asDict()
    lines = lifecycle(spark, folder, store, now, s).orderBy("section", "pos").toLocalIterator()
    files.replace(spark, f"{folder}/{s.review_file}", ((b"\n" if k else b"") + r.line.encode() for k, r in enumerate(lines)))
    return stats | link(spark, folder, store, s)
