"""Operator 2: byte-level BPE with a minimal acyclic transducer as lexicon.

The frequent words of the corpus are compiled into an automaton whose words share prefixes and suffixes and
whose arcs carry numbers; the sum along a word's path is the word's place in a table of token ids. The
automaton is a flat buffer that each worker maps into memory; all distinct words of a batch walk through it
together. Words outside the lexicon are merged exactly, pair by pair, by rank: all of a batch side by side, each step
being the next merge of every word.

Cases: a null text counts as empty (no tokens, digests of the empty string). A text's special tokens
(``<|endoftext|>``) get their own ids, as the tokenizer's file asks. Repeated rows give repeated results; an
empty table gives an empty result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import by_size, read, stash
from lorekeep.llm.words import Numbers, Remembered, cut, joined, spread

#: Words compiled into the lexicon (the most frequent ones of the corpus).
LEXICON_WORDS = 100_000
#: Words that a worker remembers before it forgets those that the present batch hasn't.
MEMORY_WORDS = 300_000
#: Bytes of a word up to which words are merged side by side; longer ones are merged one by one over a heap.
SIDE_BY_SIDE = 64
_NEVER = np.int32(1 << 30)

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """Character -> byte, as byte-level vocabularies write bytes: printable ones stand for themselves, the others
    follow from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A byte-level vocabulary: exact merging of a word's bytes, and the bytes of an id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in to_byte for c in t)}
        #: Pair of ids (as one number) -> rank of its merge, and rank -> id of what it makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[self.ids[a] << 20 | self.ids[b]] = r
            self.made.append(self.ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.pairs = Numbers.build(np.fromiter(self.rank, np.int64, len(self.rank)))
        # the place of a pair in that table is where it was built: its number in ``rank``
        self._rank_of = np.append(np.fromiter(self.rank.values(), np.int32, len(self.rank)), _NEVER)
        self._made, self._first = np.array(self.made, np.int32), np.array(self.first, np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._rank_of[self.pairs.find(a.astype(np.int64) << 20 | b)]

    def merge(self, word: bytes) -> list[int]:
        """Apply the merge of least rank, leftmost first, until none applies. Long words use a heap over a linked
        list, so that time stays near linear."""
        ids = [self.first[b] for b in word]
        if len(ids) > SIDE_BY_SIDE:
            return self._merge_long(ids)
        get, none = self.rank.get, len(self.made)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            k = ranks.index(r)
            ids[k : k + 2] = [self.made[r]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | ids[k], none)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 20 | ids[k + 1], none)
        return ids

    def merge_all(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many words, given by where each begins in ``raw`` and its bytes: all ids in a row, and how many
        each word has."""
        count, parts = np.zeros(len(size), np.int64), []
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 48, SIDE_BY_SIDE):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            for a in range(0, len(rows), 1 << 16):
                some = rows[a : a + (1 << 16)]
                ids = self._merge_block(raw, begin[some], size[some], high)
                count[some] = (ids >= 0).sum(axis=1)
                parts.append((some, ids[ids >= 0]))
        for k in np.flatnonzero(size > SIDE_BY_SIDE):
            ids = self._merge_long(self._first[raw[begin[k] : begin[k] + size[k]]].tolist())
            count[k] = len(ids)
            parts.append((np.array([k]), np.array(ids, np.int32)))
        out, at = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        for rows, ids in parts:
            out[spread(at[rows], count[rows])] = ids
        return out, count

    def _merge_block(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Words x width: ids, then -1."""
        columns = np.arange(width)
        inside = columns < size[:, None]
        ids = np.where(inside, self._first[raw[np.minimum(begin[:, None] + columns, len(raw) - 1)]], np.int32(-1))
        done = np.full((len(size), width), -1, np.int32)
        ranks = np.full((len(size), width), _NEVER, np.int32)  # of each id with the next one
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self._ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        rows = np.arange(len(size))
        while len(rows):
            at = ranks.argmin(axis=1)
            least = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            more = least < _NEVER
            if not more.all():
                done[rows[~more], : ids.shape[1]] = ids[~more]
                ids, ranks, rows, at, least = ids[more], ranks[more], rows[more], at[more], least[more]
                if not len(rows):
                    break
                if (room := int((ids >= 0).sum(axis=1).max())) < ids.shape[1]:
                    ids, ranks = ids[:, :room], ranks[:, :room]
            # what stands after the merged pair moves up by one
            i, wide = np.arange(len(rows)), ids.shape[1]
            move = np.arange(wide - 1) + (np.arange(wide - 1) > at[:, None])
            ids = np.concatenate([np.take_along_axis(ids, move, 1), np.full((len(rows), 1), -1, np.int32)], 1)
            ids[i, at] = self._made[least]
            move = np.arange(wide - 1) + (np.arange(wide - 1) >= at[:, None])
            ranks = np.concatenate([np.take_along_axis(ranks, move, 1), np.full((len(rows), 1), _NEVER, np.int32)], 1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = i[np.take_along_axis(ids, np.minimum(at + 1, wide - 1)[:, None], 1)[:, 0] >= 0]
            right = right[at[right] + 1 < wide]
            ranks[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])
        return done

    def _merge_long(self, ids: list[int]) -> list[int]:
        import heapq

        n, rank = len(ids), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p], k, p) for k in range(n - 1) if (p := ids[k] << 20 | ids[k + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            r, k, pair = heapq.heappop(heap)
            b = right[k]
            if b < 0 or ids[k] < 0 or (ids[k] << 20 | ids[b]) != pair:
                continue
            ids[k], ids[b] = self.made[r], -1
            right[k] = right[b]
            if right[b] >= 0:
                left[right[b]] = k
            for x in (left[k], k):
                if x >= 0 and right[x] >= 0 and (p := ids[x] << 20 | ids[right[x]]) in rank:
                    heapq.heappush(heap, (rank[p], x, p))
        return [i for i in ids if i >= 0]


class Lexicon:
    """A minimal acyclic transducer in one buffer. A state is a number; its arcs are keys (state * 256 + byte) of a table
    by number, with their target and their output. A word's outputs sum to its ordinal, which leads to its ids."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 5)
        slots, arcs, states, words, ids = (int(x) for x in head)
        at = 40

        def take(kind, n):
            nonlocal at
            x = np.frombuffer(buffer, kind, n, at)
            at += -(-x.nbytes // 8) * 8
            return x

        self.arcs = Numbers(take(np.int64, slots), take(np.int32, slots))
        self.target, self.out = take(np.int32, arcs), take(np.int32, arcs)
        self.final, self.starts, self.ids = take(np.uint8, states), take(np.int32, words + 1), take(np.int32, ids)

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        """Sorted insertion: each state that can't change any more is looked up among the equal ones before."""
        known: dict[tuple, int] = {}
        arcs_of: list[dict[int, int]] = []
        final: list[bool] = []
        count: list[int] = []

        def settle(node: tuple[dict[int, int], bool]) -> int:
            arcs, end = node
            key = (end, *arcs.items())
            if (s := known.get(key)) is None:
                s = known[key] = len(arcs_of)
                arcs_of.append(arcs)
                final.append(end)
                count.append(end + sum(count[t] for t in arcs.values()))
            return s

        order = sorted(words)
        path: list[list] = [[{}, False]]  # of the last word: arcs so far, whether a word ends here
        last = b""
        for w in order:
            same = next((k for k, (a, b) in enumerate(zip(last, w, strict=False)) if a != b), min(len(last), len(w)))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][0][last[len(path) - 1]] = settle((node[0], node[1]))
            path += [[{}, False] for _ in w[same:]]
            path[-1][1] = True
            last = w
        while len(path) > 1:
            node = path.pop()
            path[-1][0][last[len(path) - 1]] = settle((node[0], node[1]))
        root = settle((path[0][0], path[0][1]))
        # the root becomes state 0
        swap = {root: 0, 0: root}
        entries = []
        for s, arcs in enumerate(arcs_of):
            before = int(final[s])
            for b, t in arcs.items():
                entries.append((swap.get(s, s) * 256 + b, swap.get(t, t), before))
                before += count[t]
        entries.sort()
        ends = np.zeros(len(final), np.uint8)
        for s, e in enumerate(final):
            ends[swap.get(s, s)] = e
        starts = np.cumsum([0, *(len(words[w]) for w in order)]).astype(np.int32)
        ids = np.array([i for w in order for i in words[w]], np.int32)
        arcs = Numbers.build(np.array([x[0] for x in entries], np.int64))
        parts = [arcs.slots, arcs.places, np.array([x[1] for x in entries], np.int32), np.array([x[2] for x in entries], np.int32), ends, starts, ids]
        head = np.array([len(arcs.slots), len(entries), len(final), len(order), len(ids)], np.int64).tobytes()
        return head + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @staticmethod
    def mapped(data: bytes) -> Lexicon:
        """Map the buffer from an unlinked file: pages can be dropped under pressure and no file stays behind."""
        f = tempfile.TemporaryFile()
        f.write(data)
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ordinal of each word (given by where it begins in ``raw`` and its bytes), -1 outside the lexicon. All words
        walk together, one byte a step."""
        state, number = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        alive = np.argsort(-size, kind="stable")  # longest first, so those still walking are a prefix
        falling = -size[alive]
        for k in range(int(size.max(initial=0))):
            stop = int(np.searchsorted(falling, -k, "left"))
            alive, falling = alive[:stop], falling[:stop]
            if not len(alive):
                break
            arc = self.arcs.find(state[alive] * 256 + raw[begin[alive] + k])
            hit = arc >= 0
            state[alive[~hit]] = -1
            alive, falling, arc = alive[hit], falling[hit], arc[hit]
            state[alive] = self.target[arc]
            number[alive] += self.out[arc]
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] > 0), number, -1)

    def ids_of(self, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has."""
        begin = self.starts[ordinals].astype(np.int64)
        count = self.starts[ordinals + 1] - begin
        return self.ids[spread(begin, count)], count

    def lookup(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word; None for those outside the lexicon."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        found = self.find(np.frombuffer(b"".join(words) or b"\0", np.uint8), np.cumsum(size) - size, size)
        return [self.ids[self.starts[m] : self.starts[m + 1]].tolist() if m >= 0 else None for m in found.tolist()]


class Codec:
    """Encode and decode texts with a lexicon before the merges. What it remembers is bounded by MEMORY_WORDS."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.known = Remembered(MEMORY_WORDS)
        #: Vocabulary: each id in decimal with a comma, and its bytes.
        self.decimals = pa.array([f"{i}," for i in range(len(merges.bytes_of))], pa.large_string())
        self.bytes_of = pa.array(merges.bytes_of, pa.large_binary())
        self.lexicon_hits = 0

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words: from the lexicon, or merged."""
        raw, begin = joined(words)
        raw, size, begin = np.frombuffer(raw, np.uint8), np.diff(begin), begin[:-1]
        found = self.lexicon.find(raw, begin, size) if self.lexicon else np.full(len(size), -1)
        hit, miss = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        self.lexicon_hits += len(hit)
        count = np.zeros(len(size), np.int64)
        known, count[hit] = self.lexicon.ids_of(found[hit]) if len(hit) else (np.empty(0, np.int32), 0)
        made, count[miss] = self.merges.merge_all(raw, begin[miss], size[miss])
        ids, at = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        ids[spread(at[hit], count[hit])] = known
        ids[spread(at[miss], count[miss])] = made
        return ids, count

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, per_text = cut(texts, blank_joins=True)
        ids, count = self.known.look_up(words, self._new)
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum(per_text)]
        return ids, np.diff(ends, prepend=0)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        for s in self.merges.special:
            marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._plain(texts)
        ids, count = self._plain(pc.if_else(pa.array(marked), "", texts))
        parts, at = np.split(ids, np.cumsum(count)[:-1]), np.flatnonzero(marked)
        for k in at.tolist():  # what stands between special tokens is encoded by itself
            pieces = self.special.split(texts[k].as_py())
            between, n = self._plain(pa.array(pieces[::2], pa.string()))
            between = np.split(between, np.cumsum(n)[:-1])
            parts[k] = np.concatenate([x for a, s in zip(between, [*pieces[1::2], None], strict=True) for x in (a, np.array([self.merges.special[s]] if s else [], np.int32))])
            count[k] = len(parts[k])
        return np.concatenate(parts), count

    def decoded(self, ids: np.ndarray) -> pa.Array:
        """The bytes of each id."""
        return self.bytes_of.take(pa.array(ids))

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, count = self.ids(pa.array(texts, pa.string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] if texts else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.merges.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word occurs in the corpus: word, n. Counted in batches before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", 8 << 20):
                c = cut(batch.column("text"), blank_joins=True)[0].cast(pa.string()).value_counts()
                yield pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, merges: Merges, words: int = LEXICON_WORDS) -> bytes:
    """Compile the most frequent words of ``docs``, ``words`` at most, whatever the corpus holds."""
    # a count from which on there are few enough words, from a histogram: the driver gets no more than it asks for
    counts = stash(word_counts(docs).where("n > 1"), "words")
    size = F.floor(F.log2("n") * 16)
    least, total = None, 0
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if (total := total + r.n) > words:
            break
        least = r["size"]
    short = F.octet_length("word") <= SIDE_BY_SIDE  # what the driver gets is bounded in bytes, too
    top = [r.word.encode() for r in counts.where((size >= least) & short).select("word").collect()] if least is not None else []
    if not top:
        return Lexicon.compile({})
    length = np.fromiter(map(len, top), np.int64, len(top))
    ids, count = merges.merge_all(np.frombuffer(b"".join(top), np.uint8), np.cumsum(length) - length, length)
    return Lexicon.compile(dict(zip(top, (x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])), strict=True)))


_CODECS: dict[str, Codec] = {}


def codec(path: str, data: bytes) -> Codec:
    """One codec a worker."""
    key = f"{path}:{hashlib.md5(data).hexdigest()}"
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Merges(path), Lexicon.mapped(data))
    return _CODECS[key]


def encode_decode(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked,
    ids and decoded. ``tokenizer`` is the path of the vocabulary file, which every executor must reach."""
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(fit_lexicon(docs, Merges(tokenizer), lexicon_words))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, data.value)
        for whole in batches:
            for batch in by_size(whole, "text", 4 << 20):
                ids, count = c.ids(batch.column("text"))
                ends = np.concatenate([[0], np.cumsum(count)])
                (digits, at), (raw, to) = joined(c.decimals.take(pa.array(ids))), _bytes(c.decoded(ids))
                a, b, decoded = [], [], []
                for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    a.append(sha(digits[at[x] : max(at[x], at[y] - 1)]))  # without the last comma
                    text = str(raw[to[x] : to[y]], "utf-8", "replace")
                    b.append(sha(text.encode()))
                    if with_ids:
                        decoded.append(text)
                columns = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bytes(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """As joined(), of binary values without nulls."""
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64, len(values) + 1, values.offset * 8) if len(values) else np.zeros(1, np.int64)
    return memoryview(data) if data is not None else memoryview(b""), ends


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), tokenizer_path(DEFAULT_TOKENIZER))
