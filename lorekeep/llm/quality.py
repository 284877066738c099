"""Operator 1: quality by nearest-neighbour voting among latent-semantic vectors.

A text becomes a bag of hashed terms: its words, their shapes, the marks at their ends, and its length class.
Document frequencies are counted over the whole corpus. A truncated singular value decomposition of a bounded,
labelled sample gives the latent space; the sample's vectors, bounded in number and width, are broadcast. Every
document meets all of them in blocks of exact cosine products, and its nearest ones vote with their similarity. Cosines
are compared after rounding to nine decimals; of equal ones the sample's order counts, by doc_id and then label.

Cases: a null text counts as empty; an empty text has a length class, so it has neighbours too; without labelled
documents every score is 0.5; documents whose label is null don't vote; labels that repeat a document count once each
within the bound; repeated rows score alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded_sample, by_size, crc_mod, read
from lorekeep.llm.words import blanks, cut

#: Labelled documents in the sample, about, as many of either label as there are, by hashes of their ids.
SAMPLE = 3000
#: Hashed terms, and the latent space's width.
TERMS, WIDTH = 4096, 48
NEIGHBOURS = 25
#: The similarity's power in a vote.
SHARPNESS = 4
#: Words whose terms a worker remembers before it forgets them all.
MEMORY_WORDS = 300_000
#: Longer words aren't remembered.
LONG_WORD = 64

_TERMS: dict[str, tuple[int, int, int]] = {}
_PARTS: dict[str, int] = {}
_MARKS = "!?.,;:*#$%&|<>_~="


def _part(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind} {text}".encode()) % TERMS


def terms_of(word: str) -> tuple[int, int, int]:
    """Hashed terms of a word: its letters, its shape, and the marks at its end."""
    body = word.rstrip(_MARKS)
    sides, end = "s" + body[:2] + body[-1:], "e" + word[len(body) : len(body) + 4]
    if (s := _PARTS.get(sides)) is None:
        shape = "".join(["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in sides[1:]])
        s = _PARTS[sides] = _part("s", shape)
    if (e := _PARTS.get(end)) is None:
        e = _PARTS[end] = _part("e", end[1:])
    return _part("w", body.lower()), s, e


def bags(texts: list[str] | pa.Array, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts (text, term, count) of all texts."""
    if len(_PARTS) > MEMORY_WORDS:
        _PARTS.clear()
    words, n = cut(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, table=blanks())
    terms = np.empty((0, 3), np.int64)
    if len(words):
        enc = words.dictionary_encode()
        distinct = enc.dictionary.to_pylist()
        if len(_TERMS) > MEMORY_WORDS:  # those of this batch stay
            held = {w: _TERMS[w] for w in distinct if w in _TERMS}
            _TERMS.clear()
            _TERMS.update(held)
        met = []
        for w in distinct:
            if (t := _TERMS.get(w)) is None:
                t = terms_of(w)
                if len(w) <= LONG_WORD:
                    _TERMS[w] = t
            met.append(t)
        table = np.array(met, np.int64)
        terms = table[enc.indices.to_numpy(zero_copy_only=False)]
    length = np.array([_part("l", str(k)) for k in range(65)], np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    rows, cells, counts = [], [], []
    for a in range(0, len(texts), block):  # dense counts of a block of texts, then what isn't zero
        b = min(a + block, len(texts))
        owner = np.repeat(np.arange(b - a), n[a:b]) * TERMS
        flat = np.concatenate([(terms[ends[a] : ends[b]] + owner[:, None]).ravel(), np.arange(b - a) * TERMS + length[[int(k).bit_length() for k in n[a:b]]]])
        dense = np.bincount(flat, minlength=(b - a) * TERMS)
        at = np.flatnonzero(dense)
        rows.append(at // TERMS + a)
        cells.append(at % TERMS)
        counts.append(dense[at])
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return cat(rows), cat(cells), cat(counts)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed term occurs, over all of them; and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS + 1, np.int64), 0
        for whole in batches:
            for batch in by_size(whole, "text"):
                _, terms, _ = bags(batch.column("text"))
                df[:TERMS] += np.bincount(terms, minlength=TERMS)
                n += batch.num_rows
        df[TERMS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(df)], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        df[r.term] = r.n
    return df[:TERMS], int(df[TERMS])


@dataclass
class Voter:
    idf: np.ndarray  # weights of terms
    basis: np.ndarray  # terms x width
    vectors: np.ndarray  # sample x width, unit length
    labels: np.ndarray

    def weigh(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Weights of sparse counts, so that each of the n documents has length 1."""
        value = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, value**2, n))
        return value / np.maximum(norm[row], 1e-12)

    def embed(self, texts: list[str] | pa.Array) -> np.ndarray:
        row, term, count = bags(texts)
        value = self.weigh(row, term, count, len(texts))
        out = np.zeros((len(texts), self.basis.shape[1]))
        begin = np.searchsorted(row, np.arange(len(texts) + 1))
        for k in range(len(texts)):
            a, b = begin[k], begin[k + 1]
            out[k] = value[a:b] @ self.basis[term[a:b]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str] | pa.Array, block: int = 256) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        v = self.embed(texts)
        k = min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(texts))
        for a in range(0, len(texts), block):
            cos = v[a : a + block] @ self.vectors.T
            near = nearest(cos, k)
            weight = np.maximum(np.take_along_axis(cos, near, 1), 0) ** SHARPNESS + 1e-12
            out[a : a + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out.clip(0, 1)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Rows x k: the places of the k largest of each row, in order of place; of those equal to nine decimals the first."""
    scaled = np.rint(cos * 1e9).astype(np.int64)
    least = np.partition(scaled, scaled.shape[1] - k, axis=1)[:, scaled.shape[1] - k]
    above = scaled > least[:, None]
    tied = scaled == least[:, None]
    spare = k - above.sum(axis=1)
    if (tied.sum(axis=1) > spare).any():
        tied &= np.cumsum(tied, axis=1) <= spare[:, None]
    return np.nonzero(above | tied)[1].reshape(len(cos), k)


def fit(texts: list[str], labels: list[int], df: np.ndarray, n: int, seed: int = 5) -> Voter:
    """fit_bags() of texts."""
    return fit_bags(*bags(texts), labels, df, n, seed)


def fit_bags(row: np.ndarray, term: np.ndarray, count: np.ndarray, labels: list[int], df: np.ndarray, n: int, seed: int = 5) -> Voter:
    """The latent space of the sample (sparse counts of its documents) by randomised subspace iteration, and the sample's
    vectors in it."""
    idf = np.log((1 + n) / (1 + df)) + 0.1
    voter = Voter(idf, np.zeros((TERMS, 1)), np.zeros((0, 1)), np.array(labels, np.float64))
    if not labels:
        return voter
    dense = np.zeros((len(labels), TERMS), np.float32)
    dense[row, term] = voter.weigh(row, term, count, len(labels))
    q = np.random.default_rng(seed).standard_normal((TERMS, min(WIDTH + 10, TERMS, len(labels)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(dense @ q)
        q, _ = np.linalg.qr(dense.T @ q)
    u, s, vt = np.linalg.svd(dense @ q, full_matrices=False)
    voter.basis = (q @ vt.T[:, : min(WIDTH, len(s))]).astype(np.float64)
    v = dense @ voter.basis
    voter.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return voter


def train(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE) -> Voter:
    """``labelled``: doc_id, quality of the documents that may teach."""
    df, n = document_frequencies(docs)
    known = labelled.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), "quality").distinct()
    picked = bounded_sample(known, "quality", F.col("_id"), most)
    # the sample's bound (ids and labels, a few kB) is what allows to broadcast it
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "quality", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text"):
                row, term, number = bags(batch.column("text"))
                ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, number)]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(batch.column("quality"), pa.int32()), *lists], ["_id", "quality", "terms", "counts"])

    # bags have TERMS entries at most, whatever the texts' lengths; of a repeated document the least one
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.withColumn("quality", F.col("quality").cast("int")).mapInArrow(count, f"_id {kind}, quality int, terms array<int>, counts array<int>")
    sample = found.groupBy("_id", "quality").agg(F.min(F.struct("terms", "counts")).alias("x")).select("_id", "quality", "x.*").toArrow()
    sample = sample.sort_by([("_id", "ascending"), ("quality", "ascending")]).combine_chunks()
    flat = lambda name: np.concatenate([c.flatten().to_numpy().astype(np.int64) for c in sample.column(name).chunks] or [np.empty(0, np.int64)])
    size = pc.list_value_length(sample.column("terms")).to_numpy()
    return fit_bags(np.repeat(np.arange(len(size)), size), flat("terms"), flat("counts"), sample.column("quality").to_pylist(), df, n)


def score(docs: DataFrame, voter: Voter) -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(voter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep(docs: DataFrame, voter: Voter) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't predicted to be bad."""
    shared = docs.sparkSession.sparkContext.broadcast(voter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text"):
                yield batch.filter(pa.array(shared.value.score(batch.column("text")) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    return F.coalesce(crc_mod("doc_id", 3), F.lit(0)) == 1


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. Only labels of documents that aren't held out teach."""
    voter = train(docs, labels.where(~held_out()).select("doc_id", "quality"))
    return score(docs, voter).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
