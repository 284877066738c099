"""Operator 7: near-duplicate classes by DartMinHash.

A document is the set of its five-word shingles (or their multiset). Darts are thrown at regions of weight and
time by hashes of the shingle alone, so equal shingles throw equal darts in every document; of the darts that land
within a shingle's weight, the earliest at each coordinate makes the signature. The work is about k ln k darts a
document and one hash a shingle. Coordinates are banded; documents that share a band's key are candidates.

Candidates are not paired within a band: all members of a band meet one member (a star), the exact similarity of each
such pair is computed from the texts, links become classes, and only bands that members of several classes still share
go on. There members meet in blocks of bounded size: a text goes once to each block in which it has a partner (the first
band that the two share), the exact similarities of all pairs of a block are one product of matrices of shared features,
and of its links only as many are emitted as join its classes. So a large group of texts that are alike but not alike
enough costs a text and a row a member and block, and no pair is a row. What shares no band is not compared: of pairs
at similarity 0.8, 1 in 9,000; fewer the more similar they are. Equal texts are one node from the start, told by 128 bits.

Cases: words are split at white space; a text of one to four words is a single shingle; texts without words (null
or empty) are copies of each other; rows without doc_id are compared like all others and get their class's id;
the class id is the least doc_id of the class (null if none of its rows has one); repeated rows share a class; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import by_size, join_split, mix64, read, stash
from lorekeep.llm.words import LONG_WORD, blanks, cut, joined

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of ROWS coordinates: a pair of similarity 0.8 shares no band once in 9,000 times.
BANDS, ROWS = 30, 6
#: Members of a band that meet in one task.
BLOCK = 1024
#: Features whose matrix is multiplied at once there.
FEATURES = 4096

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_U64 = np.uint64


def word_hashes(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (by white space) of all texts in a row, and the count of words of each text. Words are
    hashed side by side, eight bytes a step."""
    import xxhash

    words, counts = cut(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, table=blanks())
    raw, begin = joined(words)
    size, begin = np.diff(begin), begin[:-1]
    padded = np.frombuffer(bytes(raw) + bytes(8), np.uint8)
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix64(size.astype(np.uint64) * _GOLD)
    at = np.flatnonzero(size <= LONG_WORD)
    step = 0
    while len(at):
        left = np.minimum(size[at] - step, 8).astype(np.uint64)
        part = eight[begin[at] + step] & (~_U64(0) >> (_U64(64) - _U64(8) * left))
        out[at] = mix64(out[at] * _GOLD + part)
        step += 8
        at = at[size[at] > step]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[begin[k] : begin[k] + size[k]])
    return out, counts


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingles of texts in a row, whose words' hashes are ``words``, and how many each text has."""
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    total = int(n.sum())
    if not total:
        return np.empty(0, np.uint64), n
    first = np.cumsum(counts) - counts
    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    end = np.repeat(first + counts, n)
    h = np.zeros(total, np.uint64)
    for k in range(SHINGLE):
        inside = at + k < end
        h = np.where(inside, mix64(h * _GOLD + words[np.minimum(at + k, len(words) - 1)] + _U64(k)), h)
    return h, n


def content_keys(words: np.ndarray, counts: np.ndarray, salt: int = 1) -> np.ndarray:
    """A 64-bit key of each text's sequence of words; another one for each ``salt``."""
    at = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    h = mix64(mix64(words + _U64(salt - 1)) ^ mix64(at.astype(np.uint64) * _GOLD + _U64(salt)))
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(h, (np.cumsum(counts) - counts)[full])
    return mix64(out + counts.astype(np.uint64) * _GOLD)


def node_keys(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's node, the other half of its 128 bits, and the node that it has where two texts share the first."""
    first, check = content_keys(words, counts), content_keys(words, counts, 2)
    return first.astype(np.int64), check.astype(np.int64), mix64(first * _GOLD + check).astype(np.int64)


def signatures(elements: np.ndarray, counts: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash of texts in a row: texts x k. ``elements`` are hashed features, ``counts`` how many each text has,
    ``weights`` theirs (1 if not given). Two texts agree at a coordinate with the probability of their weighted
    Jaccard similarity. Texts without elements get zeros."""
    out = np.zeros((len(counts), k), np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    if weights is not None:  # one strip of weight up to 1 each; the last is partly inside
        strips = np.maximum(1, np.ceil(weights)).astype(np.int64)
        part = np.arange(int(strips.sum())) - np.repeat(np.cumsum(strips) - strips, strips)
        height = np.minimum(1.0, np.repeat(weights, strips) - part)
        elements = mix64(np.repeat(elements, strips) + part.astype(np.uint64) * _GOLD)
        owner = np.repeat(owner, strips)
        mass = np.bincount(owner, height, len(counts))
    else:
        height, mass = None, counts.astype(np.float64)
    # darts of a unit strip arrive at rate 1; so many are expected before the limit that few coordinates stay empty
    limit = (k * math.log(k) + 2 * k) / np.maximum(mass, 1e-9)
    todo = mass > 0
    while todo.any():
        here = np.flatnonzero(todo[owner])
        text, seed = owner[here], elements[here]
        tall = height[here] if height is not None else None
        time = np.zeros(len(here))
        earliest = np.full(len(counts) * k, np.inf)
        darts = []
        nth = 0
        while len(text):
            h = mix64(seed + _U64((nth + 1) * int(_GOLD) % 2**64))
            time -= np.log1p((h >> _U64(11)).astype(np.float64) * -(2.0**-53))
            alive = np.flatnonzero(time < limit[text])
            if len(alive) < len(text):
                text, seed, time, h = text[alive], seed[alive], time[alive], h[alive]
                tall = tall[alive] if tall is not None else None
            value = mix64(h ^ _GOLD)
            slot, when = text * k + ((value >> _U64(32)) * _U64(k) >> _U64(32)).astype(np.int64), time.copy()
            if tall is not None:
                hit = (mix64(value + _U64(5)) >> _U64(11)).astype(np.float64) * 2.0**-53 < tall
                slot, when, value = slot[hit], when[hit], value[hit]
            np.minimum.at(earliest, slot, when)
            darts.append((slot, when, value))
            nth += 1
        flat = np.zeros(len(counts) * k, np.uint64)
        for slot, when, value in darts:
            won = when == earliest[slot]
            flat[slot[won]] = value[won]
        done = todo & np.isfinite(earliest).reshape(-1, k).all(axis=1)
        out[done] = flat.reshape(-1, k)[done]
        todo &= ~done
        limit = np.where(todo, limit * 2, limit)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Texts x BANDS."""
    parts = sig.reshape(len(sig), BANDS, -1)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, parts.shape[:2])
    for k in range(parts.shape[2]):
        h = mix64(h + parts[:, :, k])
    return h


def row_key() -> Column:
    """A key of a row's doc_id and text, which rows without doc_id have too. Equal keys of different rows do no harm:
    verify() compares the keys of the words."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """row, text: the texts under their rows' keys; those of rows without doc_id once each."""
    texts = docs.select("doc_id", row_key().alias("row"), "text")
    return texts.where("doc_id IS NOT NULL").unionByName(texts.where("doc_id IS NULL").dropDuplicates(["row"])).select("row", "text")


def features(text: pa.Array, weighting: str) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts in a row: the features whose overlap is their similarity, sorted and different within a text, how many
    each text has, and node_keys(). Of a multiset the second occurrence of a shingle is a feature of its own."""
    words, counts = word_hashes(text)
    s, n = shingles(words, counts)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    if weighting == "count":
        start = np.flatnonzero(new)
        nth = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
        s = np.where(nth > 0, mix64(s + nth.astype(np.uint64) * _GOLD), s)
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
    else:
        s, owner = s[new], owner[new]
    return s, np.bincount(owner, minlength=len(n)), node_keys(words, counts)


def sketch(docs: DataFrame, weighting: str = "set") -> DataFrame:
    """doc_id, text_hash, row (its key), node, check, spare (see node_keys()) and keys (of the bands; empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", 2 << 20):
                words, counts = word_hashes(batch.column("text"))
                s, n = shingles(words, counts)
                weights = None
                if weighting == "count":
                    owner = np.repeat(np.arange(len(n)), n)
                    order = np.lexsort((s, owner))
                    s, owner = s[order], owner[order]
                    new = np.ones(len(s), bool)
                    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
                    at = np.flatnonzero(new)
                    weights = np.diff(np.append(at, len(s))).astype(np.float64)
                    s, n = s[at], np.bincount(owner[at], minlength=len(n))
                keys = band_keys(signatures(s, n, BANDS * ROWS, weights)).astype(np.int64)
                flat = pa.array(keys[n > 0].ravel())
                offsets = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                columns = [*(batch.column(c) for c in ("doc_id", "text_hash", "row")), *map(pa.array, node_keys(words, counts)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "row", "node", "check", "spare", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), row_key().alias("row"))
    return keyed.mapInArrow(run, f"doc_id {kind}, text_hash long, row long, node long, check long, spare long, keys array<long>")


def told_apart(signed: DataFrame) -> DataFrame:
    """``signed`` with different nodes for texts that differ in check: where two share a node, each takes its spare one."""
    shared = signed.groupBy("node").agg(F.min("check").alias("_a"), F.max("check").alias("_b")).where("_a <> _b").select("node", F.lit(True).alias("_shared"))
    if not shared.limit(1).count():
        return signed.drop("check", "spare")
    return join_split(signed, shared, ["node"], "left").withColumn("node", F.when(F.col("_shared"), F.col("spare")).otherwise(F.col("node"))).drop("check", "spare", "_shared")


def partners(labelled: DataFrame) -> DataFrame:
    """(key, p, q, _b, node, id, class): of ``labelled`` (key, node, id, class, keys), the members that have a partner of
    another class in the blocks p and q of a band which is the first that the two share. Large bands are dealt over
    blocks, of which each pair meets once; _b is the member's own."""
    sizes = labelled.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = join_split(labelled, sizes, ["key"]).withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    blocks = dealt.select("key", F.least("_b", "_o").alias("p"), F.greatest("_b", "_o").alias("q"), "_b", "node", "id", "class", "keys")

    def meet(table: pa.Table) -> pa.Table:
        key, p, q = (table.column(c)[0].as_py() for c in ("key", "p", "q"))
        group, block = (table.column(c).to_numpy() for c in ("class", "_b"))
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(group), -1)
        band = int((keys[0] == key).argmax())
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        has = np.zeros(len(group), bool)
        for a in range(0, len(left), 256):
            some = left[a : a + 256]
            apart = group[some][:, None] != group[right]
            for k in range(band):
                apart &= keys[some, k][:, None] != keys[right, k]
            has[some] |= apart.any(axis=1)
            has[right] |= apart.any(axis=0)
        return table.filter(pa.array(has)).drop_columns("keys")

    return blocks.groupBy("key", "p", "q").applyInArrow(meet, "key long, p long, q long, _b long, node long, id long, class long")


def similar(s: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which texts of ``left`` and ``right`` are as similar (left x right), by the exact overlap of their features."""
    owner = np.repeat(np.arange(len(n)), n)
    _, place, often = np.unique(s, return_inverse=True, return_counts=True)
    shared = often[place] > 1
    owner, place = owner[shared], np.unique(place[shared], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, FEATURES):
        a, b = np.searchsorted(place, [low, low + FEATURES])
        held = np.zeros((len(n), FEATURES), np.float32)
        held[owner[a:b], place[a:b] - low] = 1
        both += held[left] @ held[right].T
    either = n[left][:, None] + n[right] - both
    return (either > 0) & (both >= similarity * either - 1e-9)


def compare(labelled: DataFrame, docs: DataFrame, similarity: float, weighting: str) -> DataFrame:
    """Links (a, b) that join the classes of ``labelled`` (key, node, id, class, keys): every pair of different classes that
    shares a band is compared by its texts, and of a block's links those are emitted that join what isn't joined yet."""
    found = stash(partners(labelled), "partners")
    full = found.join(keyed_texts(docs).hint("merge"), F.col("id") == F.col("row")).drop("id", "row")

    def meet(table: pa.Table) -> pa.Table:
        node, group, block = (table.column(c).to_numpy() for c in ("node", "class", "_b"))
        s, n, (first, _, spare) = features(table.column("text").combine_chunks(), weighting)
        # another text under the same row key is none of the node's; the right one is there, too
        fine = np.flatnonzero((first == node) | (spare == node))
        fine = fine[np.unique(node[fine], return_index=True)[1]]
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        left, right = fine[block[fine] == p], fine[block[fine] == q]
        linked = similar(s, n, left, right, similarity)
        _, label = np.unique(group, return_inverse=True)
        out: list[tuple[int, int]] = []
        for i, row in zip(left, linked, strict=True):
            near = right[row]
            for j in near[np.unique(label[near], return_index=True)[1]] if len(near) else ():
                if label[i] != label[j]:
                    out.append((int(node[i]), int(node[j])))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return full.groupBy("key", "p", "q").applyInArrow(meet, "a long, b long").distinct()


def verify(pairs: DataFrame, docs: DataFrame, similarity: float, weighting: str = "set") -> DataFrame:
    """Those of ``pairs`` (a, b, id_a, id_b) whose texts are as similar: a, b. The b of one a are dealt over blocks, to each
    of which the text of a goes once; a text is shuffled for each of its pairs and blocks, and none is held but that of a."""
    sizes = pairs.groupBy("a", "id_a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    centres = sizes.select("a", F.col("a").alias("node"), F.col("id_a").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), F.lit(0).alias("kind"))
    others = join_split(pairs, sizes, ["a", "id_a"]).select("a", F.col("b").alias("node"), F.col("id_b").alias("id"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("part"), F.lit(1).alias("kind"))
    # the same plan at every size: what is joined grows with the texts
    full = centres.union(others).join(keyed_texts(docs).hint("merge"), F.col("id") == F.col("row")).select("a", "node", "part", "kind", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None  # which block it is, and the features of its a
        for whole in batches:
            for batch in by_size(whole, "text", 4 << 20):
                a, node, part, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "node", "part", "kind"))
                s, n, (first, _, spare) = features(batch.column("text"), weighting)
                ends, near = np.cumsum(n), []
                # another text under the same key is passed over
                for k in np.flatnonzero((first == node) | (spare == node)).tolist():
                    mine = s[ends[k] - n[k] : ends[k]]
                    if kind[k] == 0:
                        at, own = (a[k], part[k]), mine.copy()
                    elif at == (a[k], part[k]) and len(own):
                        place = np.searchsorted(own, mine)
                        both = int((own[np.minimum(place, len(own) - 1)] == mine).sum())
                        if both >= similarity * (len(own) + len(mine) - both) - 1e-9:
                            near.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(a[near], pa.int64()), pa.array(node[near], pa.int64())], ["a", "b"])

    blocks = full.repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return blocks.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, class (its least node) of every node in ``links`` (a, b): alternating large and small stars, each round a
    stored table, until nothing changes. Only sums reach the driver."""
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = state(edges)
    while before["n"]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = join_split(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_split(large, down, ["a"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).distinct()
        edges = stash(small, "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy("a").agg(F.min("b").alias("class"))
    return stars.select(F.col("a").alias("node"), "class").union(stars.select(F.col("class").alias("node"), "class").distinct())


def mixed(labelled: DataFrame) -> DataFrame:
    """Those of ``labelled`` (key, class and others) whose band has members of several classes."""
    several = labelled.groupBy("key").agg(F.min("class").alias("_a"), F.max("class").alias("_b")).where("_a <> _b").select("key")
    return join_split(labelled, several, ["key"])


def labels(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """doc_id, text_hash, class (one of its nodes), class_id of every row: documents linked, directly or through others,
    by a similarity of that much."""
    signed = told_apart(stash(sketch(docs, weighting), "signed"))
    nodes = stash(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("id"), F.first("keys").alias("keys")), "nodes")
    # only nodes of bands that several share; the rest is done
    members = stash(mixed(nodes.select("node", F.col("node").alias("class"), "id", F.explode("keys").alias("key"))).drop("class"), "members")
    centre = members.groupBy("key").agg(F.min_by(F.struct("node", "id"), F.struct(F.xxhash64("node", F.lit(0)), "node")).alias("c"))
    met = join_split(members, centre, ["key"]).where(F.col("node") != F.col("c.node")).select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.id").alias("id_a"), F.col("id").alias("id_b"))
    links = stash(verify(stash(met.distinct(), "pairs"), docs, similarity, weighting), "links")
    label = stash(components(links), "classes")
    # what still shares bands across classes
    known = members.join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    left = stash(mixed(known), "mixed")
    if left.limit(1).count():
        more = stash(compare(left.join(nodes.select("node", "keys"), "node"), docs, similarity, weighting), "links")
        if more.limit(1).count():
            label = stash(components(links.union(more)), "classes")
    # of each class, the least doc_id
    known = nodes.select("node", "doc_id").join(label, "node", "left").select("node", "doc_id", F.coalesce("class", "node").alias("class"))
    least = known.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    by_node = join_split(known, least, ["class"]).select("node", "class", "class_id")
    return signed.select("doc_id", "text_hash", "node").join(by_node, "node").select("doc_id", "text_hash", "class", "class_id")


def classes(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """doc_id, text_hash, class_id of every row."""
    return labels(docs, similarity, weighting).drop("class")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns: of each class the row of least doc_id (then text hash), once; a row without doc_id
    only where no row of the class has one. Of rows equal in both, the one whose columns come first as JSON."""
    labelled = stash(labels(docs), "labelled")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = labelled.groupBy("class").agg(F.min(order).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.text_hash").alias("_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    kept = rows.join(first, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_hash")), "left_semi")
    if labelled.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        kept = kept.groupBy("_doc", "_text").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")
