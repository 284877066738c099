"""Operator 10: best-fit-decreasing packing of token sequences.

Executors tokenise whole texts and cut only documents longer than a sequence. Pieces of one length are
interchangeable, so best-fit decreasing runs on the histogram of lengths: one number a length, whatever the
corpus holds. A segment tree over remaining capacities finds the tightest open bin in logarithmic time; a run of
bins with the same remaining capacity is filled in one step, exactly as one document after the other would
fill it. The plan (runs of bins for ranks within a length) is bounded by the capacity and goes to the executors,
where each piece finds its place from its rank among the pieces of its length.

Cases: a null or empty text is the single end token; repeated rows are packed each; an empty table gives no
pieces; further columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.bpe import tokenizer_path
from lorekeep.llm.common import by_size, read, stash
from lorekeep.llm.words import Remembered, cut, spread

CAPACITY = 2048
END_ID = 0
DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers before it forgets those that the present batch hasn't.
MEMORY_WORDS = 500_000
#: Characters whose lower case is of another length or depends on its place, and the beginning of special tokens: texts
#: with them go to the library as they are.
CAREFUL = "[\u0130\u03a3]|<\\|"
#: Pieces of one length that are ranked in one task, about.
RANKED_ROWS = 50_000


class Tightest:
    """Open bins by remaining capacity, as runs (first bin, bins). A segment tree over the capacities counts the
    open bins below each node; the tightest fit is the leftmost capacity not under the asked size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, at: int, n: int) -> None:
        k = at + self.leaves
        while k:
            self.tree[k] += n
            k >>= 1

    def push(self, left: int, first: int, n: int) -> None:
        if n and left:
            self.runs[left].append((first, n))
            self._add(left, n)

    def pop(self, left: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of this capacity, of one run."""
        first, n = self.runs[left].pop()
        got = min(n, most)
        if got < n:
            self.runs[left].append((first + got, n - got))
        self._add(left, -got)
        return first, got

    def find(self, size: int) -> int | None:
        k = size + self.leaves
        if self.tree[k]:
            return size
        while k > 1:
            if k % 2 == 0 and self.tree[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first bin, pieces a bin, offset): the pieces of that length from that rank on,
    up to the length's next row, go to consecutive bins."""
    open_bins, out, bins = Tightest(capacity), [], 0
    for size in sorted((s for s in histogram if histogram[s]), reverse=True):
        rank, left = 0, histogram[size]
        while left:
            room = open_bins.find(size)
            per = (room or capacity) // size  # a bin that has just taken a piece is the tightest for the next
            want = left // per or 1
            if room is None:
                first, got = bins, want
                bins += got
            else:
                first, got = open_bins.pop(room, want)
            here = min(left, per * got) // got
            out.append((size, rank, first, here, capacity - (room or capacity)))
            open_bins.push((room or capacity) - here * size, first, got)
            rank += here * got
            left -= here * got
    return out


class Encoder:
    """Ids of texts by the tokenizers library, which sees each distinct word once in a while only."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        #: Whether a token ends a word.
        self.last = np.zeros(1 + max(vocabulary.values()), bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = Remembered(MEMORY_WORDS)

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words. Many go as one text: a word's last token alone ends in the end-of-word mark."""
        ids, count = [], []
        for a in range(0, len(words), 4096):
            some = words[a : a + 4096].to_pylist()
            got = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, np.int32)
            n = np.diff(np.flatnonzero(self.last[got]) + 1, prepend=0)
            if len(n) != len(some) or n.sum() != len(got):
                each = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                got, n = np.array([i for e in each for i in e], np.int32), np.array([len(e) for e in each])
            ids.append(got)
            count.append(n)
        return np.concatenate(ids), np.concatenate(count)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, CAREFUL).to_numpy(zero_copy_only=False)
        normal = unicodedata.is_normalized
        plain = texts.to_pylist()
        if not normal("NFC", "".join(plain)):  # a part of a normalised text is normalised
            whole = whole | np.array([not normal("NFC", t) for t in plain])
        words, per_text = cut(pc.if_else(pa.array(whole), "", texts), lower=True, one_digit=True)
        ids, n = self.known.look_up(words, self._new)
        count = np.diff(np.concatenate([[0], np.cumsum(n)])[np.cumsum(per_text)], prepend=0)
        if not whole.any():
            return ids, count
        parts = np.split(ids, np.cumsum(count)[:-1])
        for k in np.flatnonzero(whole).tolist():
            parts[k] = np.array(self.library.encode(plain[k], add_special_tokens=False).ids, np.int32)
            count[k] = len(parts[k])
        return np.concatenate(parts), count


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every text's ids and the end id, cut if longer than ``capacity``: doc_id, piece, start, length, ids_crc32
    and, if asked, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        for whole in batches:
            for batch in by_size(whole, "text", 4 << 20):
                ids, count = _ENCODERS[tokenizer].ids(batch.column("text"))
                size = count + 1
                full, ends = np.full(int(size.sum()), END_ID, "<u4"), np.cumsum(size)
                full[spread(ends - size, count)] = ids
                # a document's pieces: all of the capacity but the last one
                many = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), many)
                piece = spread(np.zeros(len(size), np.int64), many)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                at = (ends - size)[row] + start
                raw = memoryview(full).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1:]), pa.int32()), pa.array(full.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``parts`` (a stored table with a column length and others that identify a
    row). Ranks within a length are dealt over salted groups, so a length that most pieces share is no hot spot."""
    spark = parts.sparkSession
    by_length = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(1, -(-max(by_length.values(), default=0) // RANKED_ROWS)) * 8
    ident = [c for c in parts.columns if c != "ids"]
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*ident), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy(*ident)
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first")).select(*parts.columns, "_rank")

    rows = np.array(plan(by_length, capacity), np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    table = spark.sparkContext.broadcast(rows)
    names = list(parts.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = (rows[:, 0] << 48) | rows[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = rows[np.searchsorted(keys, (size << 48) | rank, "right") - 1] if len(size) else np.empty((0, 5), np.int64)
            nth = rank - at[:, 1]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[:, 2] + nth // np.maximum(at[:, 3], 1)), pa.array(at[:, 4] + nth % np.maximum(at[:, 3], 1) * size)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all texts: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(stash(pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path(DEFAULT_TOKENIZER))
