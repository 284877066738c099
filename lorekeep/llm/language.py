"""Operator 6: language identification by a linear-chain conditional random field.

Every word of a text gets a label. A word's score for each language sums the weights of its affixes, character
n-grams and lexicon entries; learned transitions tie neighbours together; forward-backward gives each word's
posterior in its context, so that text which switches language is labelled word by word. A document's language
is the one of largest mean posterior.

The model is trained on a bounded sample of labelled documents (TRAIN_DOCS, whole texts). Their words are cut
into segments that are joined across documents, so that the transitions see switches. Executors run
forward-backward over all words of a batch at once: products of transfer matrices within blocks, then a chain
over blocks.

Cases: a null text, or one without a letter, is ``und`` with score 0; words are runs of letters (Unicode's, so neither
fractions nor Roman numerals count), in lower case;
without any labelled document every text is ``und``; ties go to the smaller language name; repeated rows are
labelled alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded_sample, by_size, crc_mod, mix64, read, texts_of

#: Labelled documents that the model is trained on, about, dealt evenly over the languages.
TRAIN_DOCS = 1600
#: Their bytes, about, which is what the driver holds.
TRAIN_BYTES = 64 << 20
#: Words of them that training takes at most, evenly over the documents' segments.
TRAIN_WORDS = 400_000
SEGMENT, SEQUENCE, EPOCHS, BATCH = 12, 48, 4, 256
#: Hashed weights of affixes and n-grams (a power of two).
BUCKETS = 1 << 16
#: Words in the lexicon at most; each has weights of its own.
LEXICON_WORDS = 20_000
UNKNOWN = "und"
#: Words whose scores a worker remembers before it forgets them all, and their letters.
MEMORY_WORDS, MEMORY_LETTERS = 300_000, 16 << 20

#: Letters, and numerals that are no decimal digits (², ½, Ⅷ), which aren't letters.
_NEARLY = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    found = _NEARLY.findall(text.lower())
    if not found or "".join(found).isalpha():
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


def char_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in a row, and where each word's begin: bigrams and trigrams of ``^word$`` (those
    at its ends are its affixes, told apart by the marks) and affixes of four."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n) + 2
    chars = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(n), size)
    index, owner = [], []
    total = len(chars)
    h = chars.copy()
    for k in (1, 2):
        h = h[:-1] * np.uint64(1_000_003) + chars[k:]
        whole = word[: total - k] == word[k:]
        index.append((mix64(h[whole]) + np.uint64(k)) & np.uint64(BUCKETS - 1))
        owner.append(word[: total - k][whole])
    ends = np.cumsum(size)
    long = size >= 6  # four letters at least
    for start, mark in ((ends[long] - size[long] + 1, 7), (ends[long] - 5, 11)):
        h = np.full(len(start), mark, np.uint64)
        for k in range(4):
            h = h * np.uint64(1_000_003) + chars[start + k]
        index.append(mix64(h) & np.uint64(BUCKETS - 1))
        owner.append(np.flatnonzero(long))
    index, owner = np.concatenate(index).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return index[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    lexicon: dict[str, np.ndarray]
    transitions: np.ndarray  # from x to
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Words x languages. Every word has a feature, since its marks make a bigram at least."""
        if not words:
            return np.zeros((0, len(self.languages)))
        index, begin = char_features(words)
        count = np.diff(begin)
        out = np.add.reduceat(self.weights[index], begin[:-1], axis=0) / np.sqrt(count)[:, None]
        for k, w in enumerate(words):
            if (x := self.lexicon.get(w)) is not None:
                out[k] += x
        return out


def posteriors(score: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of every word by forward-backward. ``first`` marks the words that begin a text."""
    return forward_backward(score, first, transitions, start)[0]


def forward_backward(score: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and the expected number of each transition (from x to) between words of one text. All
    texts form one sequence in which a text's beginning forgets what was before it; blocks of the sequence run side by
    side."""
    n, m = score.shape
    if not n:
        return score, np.zeros((m, m))
    emit = np.exp(score - score.max(axis=1, keepdims=True))
    trans, init = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    width = max(1, int(np.sqrt(n)))  # words a block
    blocks = -(-n // width)
    pad = blocks * width - n
    e = np.concatenate([emit, np.ones((pad, m))]).reshape(blocks, width, m)
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, width)
    # transfer matrix of each block
    product = np.broadcast_to(np.eye(m), (blocks, m, m)).copy()
    for t in range(width):
        step = (product.reshape(-1, m) @ trans).reshape(blocks, m, m)
        new = f[:, t]
        step[new] = product[new].sum(axis=2, keepdims=True) * init
        step *= e[:, t, None, :]
        product = step / step.sum(axis=(1, 2), keepdims=True)
    into, out_of = np.empty((blocks, m)), np.empty((blocks, m))
    a = np.ones(m) / m
    for k in range(blocks):
        into[k] = a
        a = a @ product[k]
        a /= a.sum()
    b = np.ones(m) / m
    for k in range(blocks - 1, -1, -1):
        out_of[k] = b
        b = product[k] @ b
        b /= b.sum()
    alpha, beta = np.empty((blocks, width, m)), np.empty((blocks, width, m))
    a = into
    for t in range(width):
        a = np.where(f[:, t, None], init, a @ trans) * e[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    b = out_of
    for t in range(width - 1, -1, -1):
        beta[:, t] = b
        back = b * e[:, t]
        b = np.where(f[:, t, None], (back * init).sum(axis=1, keepdims=True), back @ trans.T)
        b /= b.sum(axis=1, keepdims=True)
    alpha, beta = alpha.reshape(-1, m)[:n], beta.reshape(-1, m)[:n]
    out = alpha * beta
    # p(x, y) of neighbours is forward(x) T(x, y) emit(y) backward(y), up to the pair's sum
    inner = np.flatnonzero(~first)
    inner = inner[inner > 0]
    left, right = alpha[inner - 1], emit[inner] * beta[inner]
    both = (left / ((left @ trans) * right).sum(axis=1, keepdims=True)).T @ right * trans
    return out / out.sum(axis=1, keepdims=True), both


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Maximum likelihood of the labels by AdaGrad. Gradients are posteriors against labels: of words for the
    emission weights, of neighbouring pairs for the transitions."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    m = len(languages)
    segments: list[tuple[int, list[str]]] = []
    for t, lang in zip(texts, langs, strict=True):
        w = words_of(t)
        segments += [(languages.index(lang), w[a : a + SEGMENT]) for a in range(0, len(w), SEGMENT)]
    rng.shuffle(segments)
    segments = segments[: TRAIN_WORDS // SEGMENT]
    vocab: dict[str, int] = {}
    ids = [vocab.setdefault(w, len(vocab)) for _, s in segments for w in s]
    gold = np.array([k for k, s in segments for _ in s], np.int64)
    ids = np.array(ids, np.int64)
    words = list(vocab)
    empty = Model(languages, np.zeros((BUCKETS, m)), {}, np.zeros((m, m)), np.zeros(m))
    if not words:
        return empty
    index, begin = char_features(words)
    owner = np.repeat(np.arange(len(words)), np.diff(begin))
    scale = 1 / np.sqrt(np.diff(begin))
    seen = np.bincount(ids, minlength=len(words))
    listed = np.argsort(-seen, kind="stable")[:LEXICON_WORDS]
    listed = listed[seen[listed] >= 3]
    weights, own = np.zeros((BUCKETS, m)), np.zeros((len(words), m))
    can_own = np.zeros((len(words), 1))
    can_own[listed] = 1
    trans, start = np.zeros((m, m)), np.zeros(m)
    g_w, g_o, g_t, g_s = np.full((BUCKETS, m), 1e-3), np.full((len(words), m), 1e-3), np.full((m, m), 1e-3), np.full(m, 1e-3)

    def descend(x, g, grad, rate):
        g += grad * grad
        x -= rate * grad / np.sqrt(g)

    count = max(1, len(ids) // SEQUENCE)
    cut = [np.arange(k * SEQUENCE, min((k + 1) * SEQUENCE, len(ids)) if k < count - 1 else len(ids)) for k in range(count)]
    for _ in range(EPOCHS):
        order = rng.permutation(count)
        for at in range(0, count, BATCH):
            rows = [cut[k] for k in order[at : at + BATCH]]
            pos = np.concatenate(rows)
            first = np.zeros(len(pos), bool)
            first[np.cumsum([0, *(len(r) for r in rows[:-1])])] = True
            used, inv = np.unique(ids[pos], return_inverse=True)
            span = np.concatenate([np.arange(begin[u], begin[u + 1]) for u in used])
            local = np.repeat(np.arange(len(used)), begin[used + 1] - begin[used])
            base = np.stack([np.bincount(local, weights[index[span], k], len(used)) for k in range(m)], 1) * scale[used, None] + own[used] * can_own[used]
            score = base[inv]
            p, joint = forward_backward(score, first, trans, start)
            y = np.eye(m)[gold[pos]]
            diff = (p - y) / len(pos) * 1000
            by_word = np.stack([np.bincount(inv, diff[:, k], len(used)) for k in range(m)], 1)
            grad = np.stack([np.bincount(index[span], (by_word * scale[used, None])[local, k], BUCKETS) for k in range(m)], 1)
            descend(weights, g_w, grad, 0.2)
            go = np.zeros_like(own)
            go[used] = by_word * can_own[used]
            descend(own, g_o, go, 0.1)
            inner = np.flatnonzero(~first)
            real = np.zeros((m, m))
            np.add.at(real, (gold[pos[inner - 1]], gold[pos[inner]]), 1)
            descend(trans, g_t, (joint - real) / len(pos) * 1000, 0.1)
            descend(start, g_s, (p[first] - y[first]).sum(0) / len(pos) * 1000, 0.1)
    lexicon = {words[k]: own[k] for k in listed}
    return Model(languages, weights, lexicon, trans, start)


def sample(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """A bounded sample of labelled documents (text, lang), as even over the languages as can be: in documents and bytes."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return bounded_sample(known, "lang", F.xxhash64("doc_id", "text"), most, F.octet_length("text"), TRAIN_BYTES).select("text", "lang")


def label_words(text: str, model: Model) -> list[tuple[str, str]]:
    """(word, language) of one text that may switch between languages."""
    words = words_of(text)
    if not words:
        return []
    first = np.zeros(len(words), bool)
    first[0] = True
    p = posteriors(model.scores(words), first, model.transitions, model.start)
    return list(zip(words, (model.languages[k] for k in p.argmax(axis=1)), strict=True))


class Labeller:
    """Scores of words, remembered up to MEMORY_WORDS."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.letters = 0
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def run(self, texts: list[str]) -> tuple[list[str], list[float]]:
        m = self.model
        split = [words_of(t) for t in texts]
        if len(self.place) > MEMORY_WORDS or self.letters > MEMORY_LETTERS:
            self.place, self.table, self.letters = {}, self.table[:0], 0
        new = list({w for s in split for w in s if w not in self.place})
        if new and m.languages:
            self.letters += sum(map(len, new))
            self.place |= zip(new, range(len(self.place), len(self.place) + len(new)), strict=True)
            parts = [m.scores(new[a : a + 20_000]).astype(np.float32) for a in range(0, len(new), 20_000)]
            self.table = np.concatenate([self.table, *parts])
        n = np.fromiter(map(len, split), np.int64, len(split))
        if not n.sum() or not m.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        get = self.place.__getitem__
        ids = np.fromiter((get(w) for s in split for w in s), np.int64, int(n.sum()))
        first = np.zeros(len(ids), bool)
        begin = (np.cumsum(n) - n)[n > 0]
        first[begin] = True
        p = posteriors(self.table[ids].astype(np.float64), first, m.transitions, m.start)
        mean = np.zeros((len(texts), len(m.languages)))
        mean[n > 0] = np.add.reduceat(p, begin, axis=0) / n[n > 0, None]
        best = mean.argmax(axis=1)
        return [m.languages[k] if c else UNKNOWN for k, c in zip(best, n, strict=True)], np.where(n > 0, mean[np.arange(len(best)), best], 0.0).clip(0, 1).tolist()


_LABELLERS: dict[str, Labeller] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = hashlib.md5(model.weights.tobytes() + model.transitions.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LABELLERS:
            _LABELLERS.clear()
            _LABELLERS[key] = Labeller(shared.value)
        for whole in batches:
            for batch in by_size(whole, "text", 2 << 20):
                lang, score = _LABELLERS[key].run(texts_of(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    rows = sorted(set((r.text, r.lang) for r in sample(docs, most).collect()))
    return fit([t for t, _ in rows], [lang for _, lang in rows])


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fold = F.coalesce(crc_mod("doc_id", 4), F.lit(0))
    model = train(docs.where(fold != 2))
    return identify(docs, model).select("doc_id", (F.coalesce(crc_mod("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")
