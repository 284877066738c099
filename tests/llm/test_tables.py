"""Nearest neighbours, URL filters and the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import ann, lines, urls
from lorekeep.llm.common import join_split

SF = "/root/testdata/sf0.001"


def table(spark, vectors, ids=None):
    rows = [(k if ids is None else ids[k], v, "x", 0) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls string, rank int")


def brute(vectors, ids, k):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in zip(ids, vectors, strict=True) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for i, q in fine:
        if i % 20 == 0:
            scored = sorted(((-float((x * q).sum()), j) for j, x in fine if j != i))[:k]
            out[i] = [j for _, j in scored]
    return out


def lists(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(out[r.query_id])
    return out


def in_order(found, vectors, k):
    """Ranks run from 1; scores are the exact products; ties go to the smaller id. Gives the share of true neighbours found."""
    x = {i: np.array(v, np.float32).astype(float) for i, v in enumerate(vectors) if v and None not in v}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id]) and r.vec_id != r.query_id
        assert r.score == float((x[r.vec_id] * x[r.query_id]).sum())
    assert all(rows == sorted(rows, key=lambda y: (-y[1], y[0])) for rows in got.values())
    want = brute(vectors, range(len(vectors)), k)
    assert set(got) == {q for q in want if want[q]} and all(len(got[q]) == len(want[q]) for q in got)
    return sum(len({i for i, _ in got[q]} & set(want[q])) for q in got) / max(1, sum(map(len, want.values())))


def test_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(90, 8)).tolist()
    v[40:70] = [v[20]] * 30  # many equal vectors: ties by id
    v += [None, [0.0] * 8, [None, *[1.0] * 7], [float("nan")] * 8, [float("inf"), *[1.0] * 7], [1.0] * 7, []]
    every = F.col("vec_id") % 20 == 0
    assert in_order(ann.search(table(spark, v), every, 20), v, 20) >= 0.9
    found = lists(ann.search(table(spark, v), every, 20))
    equal = [20, *range(40, 70)]
    for q in (20, 40, 60):  # of those equal to the query, the least ids
        mine = [i for i in found[q] if i in equal]
        assert len(mine) >= 10 and mine == [i for i in equal if i != q][: len(mine)]
    assert in_order(ann.search(table(spark, v[:5]), every, 20), v[:5], 20) == 1  # fewer candidates than asked: all
    assert ann.search(table(spark, v).limit(0), every).collect() == []
    assert ann.search(table(spark, v).where("vec_id = 0"), every).collect() == []
    assert ann.search(table(spark, v).where("vec_id = 1"), every).collect() == []
    assert lists(ann.search(table(spark, v).union(table(spark, v)), every, 20)) == found


def test_hashed_search_has_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 500)  # several groups, and blocks of a group
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 2
    v = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8))).astype(np.float32).tolist()
    v[100:160] = [v[20]] * 60
    found = ann.search(table(spark, v), F.col("vec_id") % 20 == 0, 20)
    assert in_order(found, v, 20) >= 0.9


def test_recall_on_queries_that_fitting_has_not_seen(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 30)
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v = [r.embedding for r in e.orderBy("vec_id").collect()]
    x = np.array(v, np.float32).astype(float)
    got = lists(ann.search(e, F.col("vec_id") % 20 == 0, 20))
    hits = 0
    for q, near in got.items():
        s = x @ x[q]
        s[q] = -9
        hits += len(set(near) & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hits >= 0.9 * 2000


def test_ties_among_visited_rows_go_to_the_least_id():
    for n in (50, 300, 5000):
        rng = np.random.default_rng(n)
        low = rng.permutation(n)
        x = np.eye(n)[:, : min(n, 400)]
        block = ann.Block(np.arange(n), low, x, None, 0)
        q = rng.integers(0, 50, 40)
        for i, near, score in block.search(x[q], 21):
            s = x @ x[q[i]]
            want = np.lexsort((low, -s))[:21]
            assert near.tolist() == want.tolist() and score.tolist() == s[want].tolist()


def test_one_hot_vectors(spark):
    v = np.eye(300).tolist()
    rows = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = lists(ann.search(rows, F.col("vec_id") % 20 == 0, 20))
    assert len(got) == 15 and all(len(x) == 20 and x == sorted(x) for x in got.values())
    hits = sum(len(set(x) & {i for i in range(21) if i != q}) for q, x in got.items())
    assert hits >= 0.9 * 300  # all others tie: the least ids are the true ones


def test_gains_are_the_probabilities_of_neighbours():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(4000, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    t = ann.Tables.draw(rows, 1.0, 0.6, 6)
    q = rows[0]
    near = rng.normal(size=(40_000, 16))
    near -= np.outer(near @ q, q)
    near = 0.6 * q + 0.8 * near / np.linalg.norm(near, axis=1, keepdims=True)
    cells = t.cells(near)
    gain, share = t.gains(q[None])[0], np.exp(t.shares)
    # over the random directions the estimate is right on average
    want = np.mean([[np.mean(cells[:, a, h] == c) for c in range(2 * ann.FAR + 1)] for a in range(ann.TABLES) for h in range(6)], axis=0)
    assert np.abs((np.exp(gain) * share).reshape(-1, 2 * ann.FAR + 1).mean(axis=0) - want).max() < 0.05
    # the heads are those of the buckets that reach the threshold
    t.threshold = 1.0
    for a in range(ann.TABLES):
        sums = {c: sum(gain[a, h, x] for h, x in enumerate(c)) for c in itertools.product(range(2 * ann.FAR + 1), repeat=6)}
        assert {tuple(h) for h in t.heads(gain[a], 2).tolist()} == {c[:2] for c, s in sums.items() if s >= 1.0}


def judge(url, rules):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_rules_equal_brute_force(spark):
    urls_ = [
        None, "", "no scheme", "://", "http://", "http://COM/en/x", "http://a.com/en/7", "http://example.com/en/7", "https://x.example.com/en/71?q#f", "http://notexample.com/en/7", "http://net/de/8",
        "http://example.net/de/8/", "http://example.net/de/9", "ftp://b.org/es/", "http://b.org/es", "http://b.org?/es/", "http://ÄB.org/es/é", "a://b://c.com/en/", "http://.com/en/", "http://com./en/", "x" * 5000 + "://" + "a." * 3000 + "com/en/" + "y" * 5000,
    ]
    rnd = random.Random(0)
    urls_ += [f"http://{rnd.choice(['', 'a.', 'b.c.'])}{rnd.choice(['example', 'x'])}.{rnd.choice(['com', 'net', 'org', 'de'])}/{rnd.choice(['en', 'de', 'es'])}/{rnd.randint(1, 99)}" for _ in range(300)]
    urls_ += urls_[:40]
    d = spark.createDataFrame([(k, u, "h", "r", "v", "k") for k, u in enumerate(urls_)], "page_id long, url string, html string, rule string, verdict string, key string")
    for rules in (urls.RULES, [], [("block", "example.com", "")]):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(d, rules).collect()}
        assert got == {k: judge(u, rules) for k, u in enumerate(urls_)}
    assert urls.judge(d.limit(0), urls.RULES).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("crc32(encode(key, 'utf-8')) % 7 = 0")
    levels = urls.build(universe, listed)
    assert len(levels) >= 2
    inside = listed.withColumn("_in", F.lit(True))
    wrong = universe.join(inside, "key", "left").where(urls.is_listed(levels, F.col("key")) != F.coalesce("_in", F.lit(False)))
    assert wrong.count() == 0


def test_oracles_are_sql():
    from lorekeep.llm import queries

    assert all(isinstance(sql, str) for sql in queries.ORACLE.values())


def test_a_hot_key_is_split_between_tasks(spark):
    """A third of all rows have one key. Joined plainly with an aggregate by it, one task takes them all."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16"}
    before = {c: spark.conf.get(c, None) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        rows = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"), "id")
        found = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))

        def run(query):
            got = sorted(map(tuple, query.collect()))
            return got, "skew=true" in query._jdf.queryExecution().executedPlan().toString()

        plain, dealt_plainly = run(rows.join(found, "key").select("key", "id", "n", "least"))
        ours, dealt = run(join_split(rows, found, ["key"]).select("key", "id", "n", "least"))
        assert plain == ours and len(ours) == 30_000
        assert dealt and not dealt_plainly
        texts = spark.createDataFrame([(k, f"own {k}\nlicense a\nlicense b\nlicense c\nend {k}") for k in range(3_000)], "doc_id long, text string").repartition(8)
        later, dealt = run(lines.later_occurrences(texts))
        assert [(r[0], r[2]) for r in later] == [(k, 1) for k in range(1, 3_000)] and dealt
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
