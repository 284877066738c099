"""Operator 3: personal data by patterns and by information-theoretic sanitisation.

Base spans (email, ip, card, phone) are found by fixed patterns in linear time. Each value found is a protected
entity e. Words within WINDOW words of an entity are its context; over the whole corpus, a term t discloses e if
their pointwise mutual information reaches the share DISCLOSURE of e's own information:

    log(P(t, e) / (P(t) P(e))) >= DISCLOSURE * -log P(e),   which is   P(e | t) >= P(e) ** (1 - DISCLOSURE),

with document probabilities, and with LEAST_CONTEXTS different contexts as support, counted over all mentions, in
one document or many, so that copies of one text prove nothing. Disclosing terms become spans of kind ``term`` wherever they occur outside base spans. Sanitising
replaces base spans by their kind and generalises terms to a class, or removes those that all but name the entity. Terms
are words as the text has them, cut by one pattern everywhere and then put in lower case.

Cases: a null text counts as empty and has no spans; repeated rows are treated alike (they share one context, but
count as documents); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import by_size, fresh, read, stash, texts_of, with_text

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8
DISCLOSURE = 0.9
LEAST_CONTEXTS = 3
#: Of the disclosing terms, those with such a P(e | t) are removed; the others are generalised.
NAMES = 0.999
#: Terms that are broadcast at most; more of them go through a join.
MOST_BROADCAST = 100_000

_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: the local part is all that the run has since the last match or @ sign."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted: the order of the digest."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'term')[k]}:{a}:{b}" for a, k, b in spans)


def _normal(kind: int, value: str) -> str:
    return value.lower() if kind < 2 else re.sub(r"[^0-9]", "", value)


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def contexts(docs: DataFrame) -> DataFrame:
    """(doc, entity, term, context): for each mention of an entity, the words around it, once each; ``context`` is a
    hash of all of them, ``doc`` one of the text and doc_id. A row without a term stands for the mention itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text"):
                doc, entity, term, context = [], [], [], []
                for i, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                    spans = base_spans(text)
                    if not spans:
                        continue
                    d = _hash(f"{i}:{_hash(text)}")
                    begins, ends = array("q"), array("q")
                    for m in _free(text, spans):
                        begins.append(m.start())
                        ends.append(m.end())
                    for a, k, b in spans:
                        e = _hash(f"{KINDS[k]}:{_normal(k, text[a:b])}")
                        before, after = bisect_right(ends, a), bisect_left(begins, b)
                        around = (*range(max(0, before - WINDOW), before), *range(after, min(after + WINDOW, len(ends))))
                        near = [text[begins[j] : ends[j]] for j in around]
                        c = _hash(" ".join(near))
                        doc.append(d)
                        entity.append(e)
                        term.append(None)
                        context.append(c)
                        for t in {w.lower() for w in near if len(w) > 1}:
                            doc.append(d)
                            entity.append(e)
                            term.append(t)
                            context.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(entity, pa.int64()), pa.array(term, pa.string()), pa.array(context, pa.int64())], ["doc", "entity", "term", "context"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, entity long, term string, context long")


def _free(text: str, base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The words of a text that touch no base span, in one pass over both."""
    k, reach = 0, 0  # of the base spans that begin before a word's end: how many, and the furthest end
    for m in _WORD.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start():
            yield m


def words_in(text: str) -> set[str]:
    """The different words of a text, in lower case."""
    return {w.lower() for w in set(_WORD.findall(text))}


def presence(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many documents each of ``terms`` occurs, over all documents. Up to MOST_BROADCAST terms are looked
    up where the texts are; of more, all words of all documents meet the terms in a join. Words are the same in both."""
    small = terms.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    wanted = docs.sparkSession.sparkContext.broadcast({r.term for r in terms.collect()} if small else set())
    if small and not wanted.value:
        return docs.sparkSession.createDataFrame([], "term string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for whole in batches:
            n: Counter = Counter()
            for batch in by_size(whole, "text"):
                for text in texts_of(batch.column("text")):
                    n.update(wanted.value & words_in(text) if small else words_in(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return found if small else found.join(terms, "term", "left_semi")


def disclosing(docs: DataFrame) -> DataFrame:
    """(term, p): terms that disclose an entity, with their largest P(e | t)."""
    found = stash(contexts(docs), "contexts")
    total = docs.count()
    if not total:
        return docs.sparkSession.createDataFrame([], "term string, p double")
    pair = found.where("term IS NOT NULL")
    wide = pair.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= LEAST_CONTEXTS)
    joint = wide.join(pair.groupBy("entity", "term").agg(F.count_distinct("doc").alias("n_te")), ["entity", "term"])
    joint = stash(joint, "joint")
    n_e = found.where("term IS NULL").select("entity", "doc").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    n_t = presence(docs, joint.select("term").distinct())
    p = F.least(F.col("n_te") / F.greatest("n", "n_te"), F.lit(1.0))
    scored = joint.join(n_e, "entity").join(n_t, "term").withColumn("p", p)
    reveals = F.col("p") >= F.pow(F.col("n_e") / F.lit(float(total)), F.lit(1 - DISCLOSURE))
    return scored.where(reveals).groupBy("term").agg(F.max("p").alias("p"))


def generalised(word: str) -> str:
    """The class that stands for a word: a number, a name (capital letter), or any other term."""
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"


def term_spans(text: str, terms, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Occurrences of ``terms`` that no base span touches."""
    if not terms or terms.keys().isdisjoint(words_in(text)):
        return []
    return [(m.start(), len(KINDS), m.end()) for m in _free(text, base) if m[0].lower() in terms]


def sanitised(text: str, spans: list[tuple[int, int, int]], terms) -> str:
    """The text with its spans replaced; of overlapping spans, the union by the first one's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            word = text[a:b]
            new = f"[{KINDS[k].upper()}]" if k < len(KINDS) else "" if terms[word.lower()] >= NAMES else generalised(word)
            out += [text[at:a], new]
            at = b
        at = max(at, b)
    return "".join([*out, text[at:]])


def _words_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_size(whole, "text"):
            words = [sorted(words_in(t)) for t in texts_of(batch.column("text"))]
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(row, pa.int64())), pa.array([x for w in words for x in w], pa.string())], ["_key", "term"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, clean (the sanitised text)."""
    return apply(docs, stash(disclosing(docs), "terms"))


def apply(docs: DataFrame, terms: DataFrame, carry: bool = False) -> DataFrame:
    """Find and replace, given the disclosing ``terms`` (term, p). ``carry``: all columns of docs come along, as _row."""
    import hashlib

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = F.struct(*[f"`{c}`" for c in docs.columns]) if carry else F.lit(None).cast("int")
    source = docs.select("doc_id", "text", row.alias("_row"))
    carried = source.schema["_row"].dataType.simpleString()
    small = terms.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    shared = spark.sparkContext.broadcast({r.term: r.p for r in terms.collect()} if small else {})
    if not small:  # each document gets the terms that it holds
        keyed = source.withColumn("_key", F.xxhash64("doc_id", "text"))
        own = keyed.select("_key", "text").mapInArrow(_words_of_rows, "_key long, term string").distinct().join(terms, "term")
        own = own.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "p"))).alias("terms"))
        source = keyed.join(own, "_key", "left").select("doc_id", "text", "_row", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text"):
                own = batch.column("terms").to_pylist() if not small else [None] * batch.num_rows
                counts, sha, joined, extra, clean = [], [], [], [], []
                for text, given in zip(batch.column("text").to_pylist(), own, strict=True):
                    known = shared.value if small else dict(given or [])
                    base = base_spans(text or "")
                    more = term_spans(text or "", known, base)
                    spans = sorted(base + more) if more else base
                    counts.append([sum(k == j for _, k, _ in base) for j in range(len(KINDS))])
                    sha.append(hashlib.sha256(digest(base).encode()).hexdigest())
                    joined.append(digest(spans))
                    extra.append(len(more))
                    clean.append(sanitised(text, spans, known) if text and spans else text)
                n = np.array(counts, np.int64).reshape(-1, len(KINDS))
                columns = [batch.column("doc_id"), *(pa.array(n[:, j]) for j in range(len(KINDS))), pa.array(sha, pa.string()), pa.array(joined, pa.string()), pa.array(extra, pa.int64()), pa.array(clean, pa.string()), batch.column("_row")]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_terms", "clean", "_row"])

    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + f", base_sha256 string, spans string, n_terms long, clean string, _row {carried}"
    return source.mapInArrow(run, schema)


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, texts sanitised."""
    found = apply(docs, stash(disclosing(docs), "terms"), carry=True)
    fields = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return with_text(found.select(*fields, F.col("clean").alias(fresh(docs, "clean"))), F.col(fresh(docs, "clean"))).select(*docs.columns)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents")).drop("clean", "_row")
