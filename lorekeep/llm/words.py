"""Words of all texts of a batch at once, as operations on arrays: where tokenizers and blanks cut, and ids remembered
for distinct words. No step runs once a word in Python.

Cases: null texts count as empty and have no words; a batch without texts has none; a text of any length is cut as a
whole, with working memory of some twenty times its size.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Words longer than this (bytes) aren't remembered.
LONG_WORD = 256


@functools.cache
def classes() -> np.ndarray:
    """Code point -> OTHER, LETTER, NUMBER or SPACE, as the tokenizers library's patterns know them (its Unicode version
    isn't Python's). Planes 4 to 16 hold none of the latter three."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.array([k for k in range(0x40000) if not 0xD800 <= k < 0xE000])
    text = "".join(map(chr, points.tolist()))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[points[a:b]] = kind
    return out


@functools.cache
def blanks() -> np.ndarray:
    """Code point -> SPACE where str.split() parts words, else OTHER."""
    out = np.zeros(0x110000, np.uint8)
    out[[k for k in range(0x110000) if chr(k).isspace()]] = SPACE
    return out


def joined(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (and the last one ends)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return memoryview(b""), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8)
    raw = memoryview(data)[ends[0] : ends[-1]] if data is not None else memoryview(b"")
    return raw, ends - ends[0]


def strings(begin: np.ndarray, raw) -> pa.Array:
    """Strings that stand in a row in ``raw``, by where each begins (and the last one ends)."""
    return pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(np.ascontiguousarray(begin, np.int64)), pa.py_buffer(raw))


def _points(whole: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and the byte at which each begins (and the last one ends)."""
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    kind = np.int32 if size < 1 << 31 else np.int64
    if len(points) == size:
        return points, np.arange(size + 1, dtype=kind)
    at = np.zeros(len(points) + 1, kind)
    np.cumsum((points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000) + np.int8(1), out=at[1:])
    return points, at


def cut(texts: pa.Array, *, table: np.ndarray | None = None, lower: bool = False, blank_joins: bool = False, one_digit: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row, and how many each text has. A word is a run of one class; a contraction such as 's
    or 'll at the beginning of a run is one by itself.

    ``blank_joins``: a blank belongs to the word after it, and other white space is a word, of which the last character
    before a word stands apart; else white space is left out. ``one_digit``: each number character is a word.
    ``lower``: in lower case (of texts without characters whose lower case is of another length or depends on others).
    ``table``: other classes than classes(); contractions don't count then."""
    raw, ends = joined(texts)
    if not len(raw):
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    whole = str(raw, "utf-8")
    points, at = _points(whole, len(raw))
    first = np.searchsorted(at, ends)
    if lower:
        whole = whole.lower()
        raw = whole.encode()
        points, at = _points(whole, len(raw))
    n = len(points)
    kind = (classes() if table is None else table)[points]
    new = np.empty(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    begin = first[:-1][first[:-1] < first[1:]]
    new[begin] = True
    if one_digit:
        new |= kind == NUMBER
    if blank_joins:
        after = np.flatnonzero(new[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        at_start = np.zeros(n, bool)
        at_start[begin] = True
        after = after[~at_start[after]]
        new[after - 1] = True
        new[after[points[after - 1] == 0x20]] = False
    if table is None:
        _contractions(points, new, first)
    starts = np.flatnonzero(new)
    words = strings(np.append(at[starts], at[n]), raw)
    if not blank_joins:
        keep = kind[starts] != SPACE
        words, starts = words.filter(pa.array(keep)), starts[keep]
    return words, np.diff(np.searchsorted(starts, first))


def _contractions(points: np.ndarray, new: np.ndarray, first: np.ndarray) -> None:
    """Move the borders ``new`` around the fixed contractions 's 't 'm 'd 're 've 'll."""
    at = np.flatnonzero(points == 0x27)
    at = at[new[at]]
    if not len(at):
        return
    stop = first[np.searchsorted(first, at, "right")]
    letter = lambda k: np.where(at + k < stop, points[np.minimum(at + k, len(points) - 1)], 0)
    one, two = letter(1), letter(2)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    for a, b in ("re", "ve", "ll"):
        size = np.where((one == ord(a)) & (two == ord(b)), 3, size)
    at, stop, size = at[size > 0], stop[size > 0], size[size > 0]
    new[at + 1] = False
    rest = at + size
    new[rest[rest < stop]] = True


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of runs in a row: for each run, ``count`` places from ``begin`` on."""
    if not len(count):
        return np.empty(0, np.int64)
    before = np.cumsum(count) - count
    return np.repeat(begin - before, count) + np.arange(int(count.sum()))


class Remembered:
    """Ids of distinct words. What is remembered is bounded in words and bytes; beyond, only the words of the present
    batch stay."""

    def __init__(self, most_words: int, most_bytes: int = 64 << 20):
        self.most_words, self.most_bytes = most_words, most_bytes
        self._empty()

    def _empty(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.begin, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _keep(self, words: pa.Array, count: np.ndarray, ids: np.ndarray) -> None:
        self.words, self.count, self.ids = words, count, ids
        self.begin = np.cumsum(count) - count

    def look_up(self, words: pa.Array, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` in a row, and how many each has. ``make`` does the same for distinct new words."""
        coded = words.dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        place = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = distinct.take(pa.array(new))
            ids, count = make(fresh)
            place[new] = len(self.words) + np.arange(len(new))
            self._keep(pa.concat_arrays([self.words, fresh]), np.concatenate([self.count, count]), np.concatenate([self.ids, ids.astype(np.int32)]))
        begin, count = self.begin[place], self.count[place]
        out = self.ids[spread(begin[at], count[at])], count[at]
        if len(self.words) > self.most_words or self.words.nbytes + self.ids.nbytes > self.most_bytes:
            short = np.flatnonzero(pc.binary_length(distinct).to_numpy(zero_copy_only=False) <= LONG_WORD)
            self._keep(distinct.take(pa.array(short)), count[short], self.ids[spread(begin[short], count[short])])
            if len(self.words) > self.most_words or self.words.nbytes + self.ids.nbytes > self.most_bytes:
                self._empty()
        return out


class Numbers:
    """A table from 64-bit keys (not negative) to places, for many look-ups at once: open addressing on arrays."""

    def __init__(self, slots: np.ndarray, places: np.ndarray):
        self.slots, self.places = slots, places
        self.shift, self.mask = np.uint64(64 - (len(slots).bit_length() - 1)), np.int64(len(slots) - 1)

    @staticmethod
    def build(keys: np.ndarray) -> Numbers:
        size = 1 << max(4, (4 * len(keys)).bit_length())
        out = Numbers(np.full(size, -1, np.int64), np.full(size, -1, np.int32))
        at, left = out._home(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(out.slots[at] < 0)
            taken, who = np.unique(at[free], return_index=True)
            who = free[who]
            out.slots[taken], out.places[taken] = keys[left[who]], left[who]
            wait = np.ones(len(left), bool)
            wait[who] = False
            at, left = (at[wait] + 1) & out.mask, left[wait]
        return out

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for unknown ones."""
        at = self._home(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.places[at], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            seen = self.slots[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.places[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out
