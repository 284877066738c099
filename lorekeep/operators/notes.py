"""Notes: chunks, the incremental index, recall, file vectors, near duplicates, links, staleness, the review."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.config import DEFAULTS, Settings
from lorekeep.functions import text as T
from lorekeep.functions import vectors as V
from lorekeep.sources import scratch


def chunks(notes: DataFrame, limit: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """file, heading, text, ord of every chunk of ``notes`` (file, raw). Expressions of one row: nothing is shuffled."""
    limit = limit or s.chunk_chars
    body = T.strip_related(T.strip_frontmatter(F.col("raw")), s)
    lined = F.array_join(T.split_lines(body), "\n")
    sections = F.split(lined, r"(?dm)(?=^#{1,6}[^\S\n])", -1)

    # each step binds what the next one uses more than once, as a lambda's body is evaluated as it is written
    def headed(section: Column) -> Column:
        is_one = T.is_heading(section)
        heading = F.when(is_one, T.strip(F.regexp_extract(section, r"(?d)^#{1,6}[^\S\n]+(.*)", 1))).otherwise("")
        return F.struct(heading.alias("heading"), T.strip(F.when(is_one, F.regexp_replace(section, r"\A[^\n]*\n?", "")).otherwise(section)).alias("rest"))

    def glued(x: Column) -> Column:
        full = F.when(x["heading"] != "", T.strip(F.concat(x["heading"], F.lit("\n"), x["rest"]))).otherwise(x["rest"])
        return F.struct(x["heading"].alias("heading"), full.alias("full"))

    def pieces(x: Column) -> Column:
        return F.transform(T.split_pack(x["full"], limit), lambda p: F.struct(x["heading"].alias("heading"), p.alias("text")))

    sections = F.transform(F.transform(sections, headed), glued)
    found = notes.select("file", F.posexplode(F.flatten(F.transform(sections, pieces))).alias("ord", "c"))
    return found.select("file", "c.heading", "c.text", "ord")


def file_table(notes: DataFrame, model: str, limit: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """file, hash, mtime, model; the model's key holds the chunk limit, so that another limit rebuilds."""
    key = f"{model}/{limit or s.chunk_chars}"
    return notes.select("file", T.content_hash(F.col("raw")).alias("hash"), "mtime", F.lit(key).alias("model"))


def build_index(notes: DataFrame, old_files: DataFrame, old_chunks: DataFrame, model: str, embed=V.hash_embed, limit: int | None = None, s: Settings = DEFAULTS):
    """(files, chunks with vec and reused): chunks of unchanged files are taken over, the others are made anew; files that
    are gone go. ``embed(rows, keys, text)`` gives vec beside the columns ``keys``."""
    files = file_table(notes, model, limit, s)
    same = files.join(old_files.select("file", "hash", "model"), ["file", "hash", "model"], "left_semi").select("file")
    kept = old_chunks.join(same, "file", "left_semi").select("file", "heading", "text", "ord", "vec", F.lit(True).alias("reused"))
    fresh = chunks(notes.join(same, "file", "left_anti"), limit, s)
    made = embed(fresh, ["file", "heading", "text", "ord"], "text").withColumn("reused", F.lit(False))
    return files, kept.unionByName(made)


def index_stats(files: DataFrame, found: DataFrame) -> DataFrame:
    """files, chunks, reused, embedded (the last three count chunks)."""
    counted = found.agg(F.count("*").alias("chunks"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("embedded"))
    return files.agg(F.count("*").alias("files")).join(F.broadcast(counted), F.lit(True))


def recall(found: DataFrame, queries: DataFrame, k: int | None = None, s: Settings = DEFAULTS, ident: tuple[str, ...] = ("file", "ord")) -> DataFrame:
    """The k best rows of ``found`` (vec and others) for each of ``queries`` (query, qvec): columns of both, score, rank. A
    user's handful of queries is broadcast, more run in blocks of bounded size; every task keeps its own k best before
    anything is shuffled."""
    blocks = -(-queries.count() // s.block_queries)
    best = Window.partitionBy("query").orderBy(F.desc("score"), *ident)
    parts = []
    for b in range(max(blocks, 1)):
        some = queries if blocks <= 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        pairs = found.join(F.broadcast(some), F.lit(True)).withColumn("score", V.dot(F.col("qvec"), F.col("vec"))).drop("qvec", "vec")
        parts.append(pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (k or s.recall_k)))
    return functools.reduce(DataFrame.unionByName, parts)


def positions(rows: DataFrame, order: list[Column], group: Column, descending: bool = True) -> DataFrame:
    """``rows`` with pos, their place from 1 on in ``order``. ``group`` is a coarser value in the same order with few different
    ones: their sizes are summed in one place, and the rows of each are ranked by themselves."""
    keyed = rows.withColumn("_g", group)
    before = Window.orderBy(F.desc("_g") if descending else F.asc("_g")).rowsBetween(Window.unboundedPreceding, -1)
    first = keyed.groupBy("_g").agg(F.count("*").alias("_n")).select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    return keyed.join(first, "_g").withColumn("pos", F.col("_first") + nth).drop("_g", "_first")


def format_hit(score: Column, file: Column, heading: Column, text: Column, most: int = 600) -> Column:
    head = F.concat(F.format_string("[%.3f] ", score), file, F.when(heading != "", F.concat(F.lit(" › "), heading)).otherwise(""))
    return F.concat(head, F.lit("\n"), F.when(F.length(text) > most, F.concat(T.rstrip(F.substring(text, 1, most)), F.lit(" …"))).otherwise(text))


def file_vectors(found: DataFrame, dim: int, only_top_level: bool = False, centered: bool = False) -> DataFrame:
    """file, vec: the normalised mean of a file's chunk vectors; files whose mean is zero have none. Centred, the mean over
    the files is taken off (from two files on) and the rest normalised again."""
    rows = found.where(~F.col("file").contains("/")) if only_top_level else found
    mean = rows.groupBy("file").agg(V.mean_vector(V.as_double(F.col("vec")), dim).alias("vec"))
    unit = mean.where(F.exists("vec", lambda x: x != 0)).select("file", V.l2_normalize(F.col("vec")).alias("vec"))
    if not centered:
        return unit
    # one row of so many doubles
    middle = unit.agg(V.mean_vector(F.col("vec"), dim).alias("_mean"), F.count("*").alias("_n"))
    moved = F.when(F.col("_n") >= 2, V.l2_normalize(F.zip_with("vec", "_mean", lambda x, m: x - m))).otherwise(F.col("vec"))
    return unit.join(F.broadcast(middle), F.lit(True)).select("file", moved.alias("vec"))


#: Blocks of a group, which a block meets in one task; rows of a block whose products are held at once; pairs of a batch.
GROUP_BLOCKS, ROWS, LISTED = 32, 256, 4096


def _packed(vectors: DataFrame, s: Settings, per_group: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, groups): the vectors in order of their files, in rows of about block_rows and of about GROUP_BLOCKS times
    as many. Blocks have p, g, names, data and groups gg, ps (the block of each row), gnames, gdata. They are written once
    to the shared folder, so that vectors are shuffled but once or twice, whatever number of others each one meets."""
    conf = vectors.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    kept = scratch.stash(vectors.select("file", "vec"), "vectors")
    most, per_group = s.block_rows, per_group or GROUP_BLOCKS

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), pa.Table.from_batches(batches, FILE_VEC) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        pieces = -(-rows.num_rows * 2 // (3 * most))
        for k, at in enumerate(np.array_split(np.arange(rows.num_rows), pieces)):
            some = rows.slice(at[0], len(at)).combine_chunks()
            x = np.ascontiguousarray(some.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
            row = {"p": [part << 20 | k], "g": [part // per_group], "names": [some.column("file").to_pylist()], "data": [x.tobytes()]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("p", pa.int64()), ("g", pa.int64()), ("names", pa.list_(pa.string())), ("data", pa.binary())]))

    import pyarrow as pa

    FILE_VEC = pa.schema([("file", pa.string()), ("vec", pa.list_(pa.float64()))])
    dealt = kept.repartitionByRange(max(1, -(-kept.count() // most)), "file").sortWithinPartitions("file")
    blocks = scratch.stash(dealt.mapInArrow(pack, "p long, g long, names array<string>, data binary"), "blocks")

    def gather(table):
        import numpy as np
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["p"])
        names = [n for r in rows for n in r["names"]]
        ps = np.repeat([r["p"] for r in rows], [len(r["names"]) for r in rows])
        out = {"gg": [rows[0]["g"]], "ps": [ps.tolist()], "gnames": [names], "gdata": [b"".join(r["data"] for r in rows)]}
        return pa.Table.from_pydict(out, pa.schema([("gg", pa.int64()), ("ps", pa.list_(pa.int64())), ("gnames", pa.list_(pa.string())), ("gdata", pa.binary())]))

    groups = blocks.groupBy("g").applyInArrow(gather, "gg long, ps array<bigint>, gnames array<string>, gdata binary")
    return blocks, scratch.stash(groups, "groups")


def _meet(left: DataFrame, groups: DataFrame, on: Column, work, schema: str) -> DataFrame:
    """work(row, names, x, group's blocks, group's names, group's x) of each row of ``left`` with each group that fits
    ``on``: a cartesian product of partitions, whose rows are read anew for each task but stored only once."""
    n_left, n_groups = left.count(), groups.count()
    pairs = left.repartition(max(1, n_left)).join(groups.repartition(max(1, n_groups)).hint("shuffle_replicate_nl"), on)

    def run(batches):
        for met in _sides(batches):
            yield from work(*met)

    return pairs.mapInArrow(run, schema)


def _sides(batches):
    """(row, names, x, group's blocks, group's names, group's x) of each row of a block with a group."""
    import numpy as np

    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            names, others = row["names"].values, row["gnames"].values
            x = np.frombuffer(row["data"].as_buffer(), np.float64).reshape(len(names), -1)
            y = np.frombuffer(row["gdata"].as_buffer(), np.float64).reshape(len(others), -1)
            yield row, names, x, row["ps"].values.to_numpy(), others, y


def _pass_by(blocks: DataFrame, groups: DataFrame, run, schema: str) -> DataFrame:
    """run(batches) of each partition of ``blocks``, by which all groups pass one by one, in any order: it is the streamed
    side of the product, of which no task holds more than one. Each block meets its own group and later ones."""
    return groups.coalesce(1).join(blocks.hint("shuffle_replicate_nl"), F.col("g") <= F.col("gg")).mapInArrow(run, schema)


def _squeezed(n) -> bytes:
    """An array of small counts, (files, grades): by grade, one place of the numbers after the other."""
    import zlib

    import numpy as np

    return zlib.compress(np.ascontiguousarray(n.T, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unsqueezed(data: bytes, rows: int):
    import zlib

    import numpy as np

    flat = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(flat).view("<u4").reshape(-1, rows).T


def _over(threshold: float, s: Settings):
    """A function from a block and a group to runs of (at, i, j, t) of its pairs a < b whose product, rounded to nine places,
    reaches the threshold: row i of the block, row at + j of the group, the product in thousandths. Runs come in order of the
    group's rows, pairs in order of i and j, a bounded number at a time. Products are taken in single precision; those that
    may be off by it, near the threshold or between two thousandths, are summed again in double precision."""
    step, rows = min(s.block_rows, 1 << 20), ROWS

    def found(p, x, ps, y):
        import numpy as np

        first = int(np.searchsorted(ps, p, "right")) - len(x) if p in ps else 0  # earlier rows come before the block
        x32, y32 = x.astype(np.float32), y.astype(np.float32)
        longest = [np.sqrt(np.einsum("ij,ij->i", z, z)) for z in (x, y)]
        near = 1e-7 + (x.shape[1] + 4) * 2.0**-24 * float(np.prod([z[np.isfinite(z)].max(initial=1) for z in longest]))
        held = np.empty(min(rows, len(x)) * min(step, len(y)), np.float32)
        for at in range(first, len(y), step):
            own, width = p in ps[at : at + step], len(y[at : at + step])
            for top in range(0, len(x), rows):
                m = held[: len(x[top : top + rows]) * width]
                np.matmul(x32[top : top + rows], y32[at : at + width].T, out=m.reshape(-1, width))
                hit = np.flatnonzero(m >= threshold - near)
                v = m[hit].astype(np.float64)
                i = hit // width
                j = hit - i * width
                i += top
                part = v * 1000 + 0.5
                t = np.floor(part)
                part -= t
                unsure = np.flatnonzero((part < 1000 * near) | (part > 1 - 1000 * near) | (v < threshold + near))
                low = np.zeros(len(hit), bool)
                for k in range(0, len(unsure), 2048):
                    some = unsure[k : k + 2048]
                    exact = np.cumsum(x[i[some]] * y[at + j[some]], axis=1)[:, -1]
                    t[some] = np.floor(exact * 1000 + 0.5)
                    low[some] = ~(np.floor(exact * 1e9 + 0.5) / 1e9 >= threshold)
                if own:
                    low |= (ps[at + j] == p) & (at + j - first <= i)
                if low.any():
                    i, j, t = i[~low], j[~low], t[~low]
                if len(i):
                    yield at, i, j, t

    return found


def _listed(pairs: DataFrame, s: Settings, *more: str) -> DataFrame:
    """a, b, score and ``more`` of pairs in the form that _lists() gives."""
    bits = _bits(s)
    each = pairs.select("names", "others", "score", *more, F.posexplode("cells").alias("_k", "_cell"))
    return each.select(F.get("names", F.shiftright("_cell", bits)).alias("a"), F.get("others", F.col("_cell").bitwiseAND((1 << bits) - 1)).alias("b"), *(F.get(c, F.col("_k")).alias(c) for c in ("score", *more)))


def _bits(s: Settings) -> int:
    return max(1, (min(s.block_rows, 1 << 20) - 1).bit_length())


def _lists(names, others, at, i, j, s: Settings, **values):
    """Batches of one row for a bounded number of pairs: the names of both sides once, a number for the two places of each
    pair, and its ``values``. Spark lists the pairs, as two strings a pair cost more on their way than all else."""
    import numpy as np
    import pyarrow as pa

    bits, step = _bits(s), min(s.block_rows, 1 << 20)
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    right = whole(others.slice(at, step))
    for k in range(0, len(i), LISTED):
        top = int(i[k])
        cells = ((i[k : k + LISTED] - top << bits) | j[k : k + LISTED]).astype(np.int32)
        left = names.slice(top, int(i[k : k + LISTED][-1]) - top + 1)
        yield pa.RecordBatch.from_arrays([whole(left), right, whole(pa.array(cells)), *(whole(pa.array(x[k : k + LISTED])) for x in values.values())], ["names", "others", "cells", *values])


#: Columns of _lists().
LISTS = "names array<string>, others array<string>, cells array<int>, score array<double>"


def dup_pairs(vectors: DataFrame, threshold: float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """a < b, score of files whose product reaches the threshold. Exact whatever the size."""
    threshold = s.dup_threshold if threshold is None else threshold
    found, (blocks, groups) = _over(threshold, s), _packed(vectors, s)

    def work(row, names, x, ps, others, y):
        for at, i, j, t in found(row["p"].as_py(), x, ps, y):
            yield from _lists(names, others, at, i, j, s, score=t / 1000)

    return _listed(_meet(blocks, groups, F.col("g") <= F.col("gg"), work, LISTS), s)


def dup_count(vectors: DataFrame, threshold: float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """pairs: how many rows dup_pairs() has, counted where they are found."""
    threshold = s.dup_threshold if threshold is None else threshold
    found, (blocks, groups) = _over(threshold, s), _packed(vectors, s)

    def work(row, names, x, ps, others, y):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([sum(len(i) for _, i, _, _ in found(row["p"].as_py(), x, ps, y))], pa.int64())], ["n"])

    return _meet(blocks, groups, F.col("g") <= F.col("gg"), work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


def dup_positions(vectors: DataFrame, threshold: float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """dup_pairs() with pos, their place from 1 on by score from the best, a, b. Pairs are neither sorted nor shuffled: a
    first pass counts those of each file and score (of three decimals), by which a second one, over the same stored
    vectors, numbers them where it finds them. As files are in order, a pair's place among those of the same file and
    score is the order in which they are found. All groups pass by a block in one task, so that its counts are stored
    once, beside the block, and aren't shuffled."""
    threshold = s.dup_threshold if threshold is None else threshold
    # groups are streamed from their files, which holds more copies of one at once
    found, (blocks, groups) = _over(threshold, s), _packed(vectors, s, -(-GROUP_BLOCKS // 4))
    width = 1003 - int(threshold * 1000)  # scores 1.001, 1, 0.999 and so on, from the best

    def grade(t):
        return 1001 - t.astype("int64")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        held: dict = {}
        for row, names, x, ps, others, y in _sides(batches):
            p, n = row["p"].as_py(), np.zeros(len(x) * width, np.uint32)
            for _, i, _, t in found(p, x, ps, y):
                low, high = i[0] * width, (i[-1] + 1) * width
                n[low:high] += np.bincount(i * width + grade(t) - low, minlength=high - low).astype(np.uint32)
            n = n.reshape(-1, width)
            own = held.setdefault(p, {c: row[c].as_py() for c in ("p", "g", "names", "data")} | {"ggs": [], "counts": [], "sums": np.zeros(width, np.int64)})
            own["ggs"].append(row["gg"].as_py())
            own["counts"].append(_squeezed(n))
            own["sums"] += n.sum(axis=0, dtype=np.int64)
        schema = pa.schema([("p", pa.int64()), ("g", pa.int64()), ("names", pa.list_(pa.string())), ("data", pa.binary()), ("ggs", pa.list_(pa.int64())), ("counts", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])
        for own in held.values():
            yield pa.RecordBatch.from_pylist([own | {"sums": own["sums"].tolist()}], schema)

    counted = _pass_by(blocks.repartition(max(1, blocks.count())), groups, count, "p long, g long, names array<string>, data binary, ggs array<bigint>, counts array<binary>, sums array<bigint>")
    counted = scratch.stash(counted, "counts")
    sums = counted.select("p", F.posexplode("sums").alias("k", "n"))
    first = sums.select("k", "p", (F.sum("n").over(Window.partitionBy("k").orderBy("p")) - F.col("n")).alias("earlier"))
    # one row for each score
    better = sums.groupBy("k").agg(F.sum("n").alias("n")).select("k", (F.sum("n").over(Window.orderBy("k")) - F.col("n")).alias("better"))
    base = first.join(F.broadcast(better), "k").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("earlier") + F.col("better")).alias("n")))).alias("base"))
    # a row of so many sums for each block of files; a shuffle would copy the blocks and their counts
    starts = F.broadcast(base.select("p", F.col("base.n").alias("base")))

    def number(batches):
        import numpy as np

        held: dict = {}
        for row, names, x, ps, others, y in _sides(batches):
            p, load = row["p"].as_py(), lambda k: _unsqueezed(row["counts"].values[k].as_py(), len(x))  # noqa: B023
            ggs = row["ggs"].values.to_pylist()
            if p not in held:
                if len(held) >= 4:
                    held.clear()
                n = np.zeros((len(x), width), np.int64)
                for k in range(len(ggs)):
                    n += load(k)
                held[p] = row["base"].values.to_numpy() + np.cumsum(n, axis=0) - n
            at = held[p].copy()
            for k, gg in enumerate(ggs):
                if gg < row["gg"].as_py():
                    at += load(k)
            at = at.ravel()
            for begin, i, j, t in found(p, x, ps, y):
                g = grade(t)
                # pairs by file, score and the other file, by two sorts of short numbers
                order = np.argsort(g.astype(np.uint16), kind="stable")
                order = order[np.argsort((i - i[0]).astype(np.uint16)[order], kind="stable")]
                i, j, g = i[order], j[order], g[order]
                cell = i * width + g
                starts_at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                sizes = np.diff(np.r_[starts_at, len(cell)])
                pos = np.repeat(at[cell[starts_at]] + 1 - starts_at, sizes) + np.arange(len(cell))
                at[cell[starts_at]] += sizes
                yield from _lists(names, others, begin, i, j, s, score=(1001 - g) / 1000, pos=pos)

    return _listed(_pass_by(counted.drop("sums").join(starts, "p"), groups, number, LISTS + ", pos array<bigint>"), s, "pos")


def links(vectors: DataFrame, slugs: DataFrame, top_n: int | None = None, threshold: float | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """file, rank, target, slug, score: the best other files of each file, from the threshold on. The index file is
    neither source nor target, though it counts in the centring. A block keeps its rows' best of a group before the shuffle."""
    top_n, threshold = top_n or s.link_top_n, s.link_threshold if threshold is None else threshold
    excluded, step = s.index_file, s.block_rows
    near = 1e-5  # more than products of unit vectors in single precision can be off

    def work(row, names, x, ps, others, y):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        p = row["p"].as_py()
        first = int(np.searchsorted(ps, p)) if p in ps else len(y)
        x32, y32 = x.astype(np.float32), y.astype(np.float32)
        least = np.full(len(x), threshold - near, np.float32)
        least[pc.equal(names, excluded).to_numpy(zero_copy_only=False)] = np.inf
        never = np.flatnonzero(pc.equal(others, excluded).to_numpy(zero_copy_only=False))
        a, b, v = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(y), step):
            m = x32 @ y32[at : at + step].T
            m[:, never[(never >= at) & (never < at + step)] - at] = -np.inf
            own = np.arange(max(first, at), min(first + len(x), at + step, len(y)))
            m[own - first, own - at] = -np.inf
            if not at and m.shape[1] > top_n:
                least = np.maximum(least, np.partition(m, m.shape[1] - top_n, axis=1)[:, m.shape[1] - top_n] - np.float32(2 * near))
            i, j = np.nonzero(m >= least[:, None])
            if not len(i):
                continue
            exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 16384]], y[at + j[k : k + 16384]]) for k in range(0, len(i), 16384)])
            keep = np.floor(exact * 1e9 + 0.5) / 1e9 >= threshold
            a, b, v = np.concatenate([a, i[keep]]), np.concatenate([b, at + j[keep]]), np.concatenate([v, exact[keep]])
            order = np.lexsort((b, -np.round(v, 12), a))
            a, b, v = a[order], b[order], v[order]
            nth = np.arange(len(a)) - np.searchsorted(a, a)
            a, b, v, nth = (c[nth < top_n] for c in (a, b, v, nth))
            full = nth == top_n - 1
            least[a[full]] = np.maximum(least[a[full]], (v[full] - 2 * near).astype(np.float32))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), others.take(pa.array(b)), pa.array(v)], ["a", "b", "score"])

    found = _meet(*_packed(vectors, s), F.lit(True), work, "a string, b string, score double")
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("score", 12)), "b"))
    best = found.withColumn("rank", nth).where(F.col("rank") <= top_n)
    return best.join(slugs.select(F.col("file").alias("b"), "slug"), "b").select(F.col("a").alias("file"), "rank", F.col("b").alias("target"), "slug", "score")


def slugs(notes: DataFrame) -> DataFrame:
    return notes.select("file", T.slug_of(F.col("raw"), T.stem_kebab(F.col("file"))).alias("slug"))


def apply_links(notes: DataFrame, found: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """file, raw, changed of the notes that have links, with their block made anew; ``changed`` ones need writing."""
    blocks = found.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "slug", "score"))), lambda x: F.struct(x["slug"].alias("slug"), x["score"].alias("score"))).alias("links"))
    new = F.concat(T.remove_block(F.col("raw"), s), F.lit("\n"), T.render_block(F.col("links"), s), F.lit("\n"))
    return notes.join(blocks, "file").select("file", new.alias("new_raw"), (new != F.col("raw")).alias("changed"))


def stale(notes: DataFrame, now: Column, days: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """file, age_days of top-level notes not touched for that long."""
    age = T.age_days(F.col("mtime"), now)
    kept = notes.where(~F.col("file").contains("/") & ~F.col("file").isin(s.review_file, s.index_file) & (age >= F.lit(float(s.stale_days if days is None else days))))
    return kept.select("file", F.round(age, 1).alias("age_days"))


def review(stale_rows: DataFrame, pairs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """section, pos, line of the review, in order: each list with its count, or a word for none."""
    spark = stale_rows.sparkSession
    # Fixed value: the report's wording.
    intro = ["# Ревизия памяти (авто, lorekeep)", "", "Сгенерировано автоматически. **Ничего не удалено** — это кандидаты на ревизию.", "Реши вручную: обновить / слить / удалить / оставить.", ""]
    head = spark.createDataFrame([(0, k, x) for k, x in enumerate(intro)], "section int, pos long, line string")

    def part(section: int, rows: DataFrame, title: str, by: str, order: list[Column], line: Column) -> DataFrame:
        count = rows.agg(F.count("*").alias("n"))
        top = count.select(F.lit(section).alias("section"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.concat(F.lit(f"{title} — "), F.col("n").cast("string")).alias("line")), F.struct(F.lit(1).cast("long").alias("pos"), F.lit("").alias("line")))).alias("x")).select("section", "x.*")
        none = count.where("n = 0").select(F.lit(section).alias("section"), F.lit(2).cast("long").alias("pos"), F.lit("_нет_").alias("line"))
        body = positions(rows, [F.desc(by), *order], F.col(by)).select(F.lit(section).alias("section"), (F.col("pos") + 1).cast("long").alias("pos"), line.alias("line"))
        end = spark.createDataFrame([(section, 1 << 62, "")], "section int, pos long, line string")
        return top.union(none).union(body).union(end)

    a = part(1, stale_rows, f"## Протухшие (> {s.stale_days} дн. без правок)", "age_days", [F.col("file")], F.concat(F.lit("- `"), "file", F.lit("` — "), F.col("age_days").cast("string"), F.lit(" дн.")))
    b = part(2, pairs, f"## Похожие пары (cosine ≥ {s.dup_threshold})", "score", [F.col("a"), F.col("b")], F.concat(F.lit("- `"), "a", F.lit("` ⇄ `"), "b", F.lit("` — "), F.col("score").cast("string")))
    return head.union(a).union(b)


def known_projects(sessions: DataFrame, notes: DataFrame) -> DataFrame:
    """name: stems of session files and of top-level project_*.md files, sorted."""
    stem = F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), r"\.md$", "")
    named = F.regexp_extract("file", r"^project_(.+)\.md$", 1)
    return sessions.where(F.col("file").endswith(".md")).select(stem.alias("name")).union(notes.where(named != "").select(F.translate(named, "_", "-").alias("name"))).distinct().orderBy("name")


