from datetime import datetime

from pyspark.sql import functions as F

from lorekeep.config import DEFAULTS
from lorekeep.functions import text as T
from lorekeep.functions import vectors as V
from lorekeep.operators import notes as N
from lorekeep.sources import notes as S
from lorekeep.sources import state

START, END = DEFAULTS.related_start, DEFAULTS.related_end
def now():
    return F.to_timestamp(F.lit("2024-03-01 00:00:00"))



def notes(spark, **raws):
    return spark.createDataFrame([(f"{k}.md", v) for k, v in raws.items()], "file string, raw string")


def got(spark, raw, limit=None):
    return [(r.heading, r.text) for r in N.chunks(notes(spark, a=raw), limit).orderBy("ord").collect()]


def test_sections_and_frontmatter(spark):
    assert got(spark, "---\nname: x\n---\nbody") == [("", "body")]
    assert got(spark, "# A\naaa\n# B\nbbb") == [("A", "A\naaa"), ("B", "B\nbbb")]
    assert got(spark, "intro\n#x\n# \ntail") == [("", "intro\n#x"), ("", "tail")]
    assert got(spark, "") == []
    assert got(spark, "# only") == [("only", "only")]
    assert got(spark, "```\n# in code\n```\r\nend") == [("", "```"), ("in code", "in code\n```\nend")]


def test_packing_is_greedy_and_never_cuts(spark):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    pieces = got(spark, f"# H\n{a}\n\n{b}\n \n{c}", 50)
    assert [p for _, p in pieces] == [f"H\n{a}", b, c]
    assert got(spark, "x" * 200, 50) == [("", "x" * 200)]
    assert got(spark, "x" * 50, 50) == [("", "x" * 50)]


def test_related_blocks_are_cut_in_two_ways(spark):
    raws = {"both": f"a \n{START}x{END}\n b", "open": f"a {START} x", "swapped": f"a {END} b {START} c", "none": "a \n"}
    d = notes(spark, **raws)
    strip = {r.file[:-3]: r.t for r in d.select("file", T.strip_related(F.col("raw")).alias("t")).collect()}
    cut = {r.file[:-3]: r.t for r in d.select("file", T.remove_block(F.col("raw")).alias("t")).collect()}
    assert strip == {"both": "a\nb\n", "open": f"a {START} x", "swapped": f"a {END} b\n", "none": "a \n"}
    assert cut == {"both": "a\n\nb\n", "open": "a\n", "swapped": f"a {END} b\n\nb {START} c\n", "none": "a\n"}


def test_slug(spark):
    rows = N.slugs(notes(spark, a="---\nname:  my-slug \n---\nx", b_c="x", d="---\nname:\nnext\n---\n")).collect()
    assert {r.file: r.slug for r in rows} == {"a.md": "my-slug", "b_c.md": "b-c", "d.md": "next"}


def index(spark, d, old=None):
    files, chunks = old or (spark.createDataFrame([], "file string, hash string, mtime timestamp, model string"), spark.createDataFrame([], "file string, heading string, text string, ord int, vec array<double>"))
    return N.build_index(d.withColumn("mtime", now()), files, chunks, "m")


def test_index_reuses_what_has_not_changed(spark):
    first = index(spark, notes(spark, a="# A\ncats purr", b="# B\nrockets fly"))
    assert N.index_stats(*first).first().asDict() == {"files": 2, "chunks": 2, "reused": 0, "embedded": 2}
    again = index(spark, notes(spark, a="# A\ncats purr", b="# B\nrockets fly"), first)
    assert N.index_stats(*again).first().embedded == 0
    third = index(spark, notes(spark, a="# A\ncats purr", b="# B\nships sail"), first)
    assert N.index_stats(*third).first().asDict() == {"files": 2, "chunks": 2, "reused": 1, "embedded": 1}
    full = index(spark, notes(spark, a="# A\ncats purr", b="# B\nships sail"))
    assert sorted(map(str, third[1].drop("reused").collect())) == sorted(map(str, full[1].drop("reused").collect()))
    assert index(spark, notes(spark, a="# A\ncats purr"), first)[1].count() == 1


def test_recall_ranks_the_relevant_note_first(spark):
    chunks = index(spark, notes(spark, a="cats purr and sleep", b="rockets fly to orbit"))[1]
    q = V.hash_embed(spark.createDataFrame([(1, "where do rockets fly")], "query int, t string"), ["query"], "t").withColumnRenamed("vec", "qvec")
    hits = N.recall(chunks, q, 1).collect()
    assert [h.file for h in hits] == ["b.md"]
    assert N.recall(chunks.limit(0), q).count() == 0


def test_recall_ties_have_an_order(spark):
    chunks = index(spark, notes(spark, b="same words", a="same words", c="same words"))[1]
    q = V.hash_embed(spark.createDataFrame([(1, "same words")], "query int, t string"), ["query"], "t").withColumnRenamed("vec", "qvec")
    assert [h.file for h in N.recall(chunks, q, 2).orderBy("rank").collect()] == ["a.md", "b.md"]


def vectors(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()], "file string, vec array<double>").withColumn("ord", F.lit(0))


def test_centring_of_two_files_gives_opposites(spark):
    v = N.file_vectors(vectors(spark, {"a": [1, 0], "b": [0, 1]}), 2, centered=True)
    assert round(N.dup_pairs(v, -1.0).first().score, 6) == -1
    one = N.file_vectors(vectors(spark, {"a": [3, 4], "zero": [0, 0]}), 2, centered=True)
    assert [(r.file, r.vec) for r in one.collect()] == [("a", [0.6, 0.8])]


def test_pairs_do_not_depend_on_blocks(spark):
    import random

    from lorekeep.config import Settings

    rnd = random.Random(1)
    v = N.file_vectors(vectors(spark, {f"f{k}": [rnd.gauss(0, 1) for _ in range(3)] for k in range(40)}), 3, centered=True)
    small, large = Settings(block_rows=7), Settings(block_rows=1000)
    key = lambda d: sorted((r.a, r.b, r.score) for r in d.collect())
    assert key(N.dup_pairs(v, 0.5, small)) == key(N.dup_pairs(v, 0.5, large))
    slug = v.select("file", F.col("file").alias("slug"))
    rows = lambda d: sorted((r.file, r["rank"], r.target) for r in d.collect())
    assert rows(N.links(v, slug, s=small)) == rows(N.links(v, slug, s=large))


def test_positions_and_counts_of_pairs_do_not_depend_on_blocks(spark, monkeypatch):
    import random

    from lorekeep.config import Settings

    rnd = random.Random(2)
    rows = {f"f{k}": [rnd.choice([-1, 1, 2]) for _ in range(3)] for k in range(60)}  # many copies and ties
    v = N.file_vectors(vectors(spark, rows), 3, centered=True)
    monkeypatch.setattr(N, "GROUP_BLOCKS", 3)
    for s in (Settings(block_rows=5), Settings(block_rows=1000)):
        pairs = sorted(((r.a, r.b, r.score) for r in N.dup_pairs(v, 0.1, s).collect()), key=lambda r: (-r[2], r[0], r[1]))
        assert len(pairs) > 200 and all(a < b for a, b, _ in pairs)
        assert [(*r, k) for k, r in enumerate(pairs, 1)] == sorted(((r.a, r.b, r.score, r.pos) for r in N.dup_positions(v, 0.1, s).collect()), key=lambda r: r[3])
        assert N.dup_count(v, 0.1, s).first().pairs == len(pairs)
    slug = v.select("file", F.col("file").alias("slug"))
    rows = lambda d: sorted((r.file, r["rank"], r.target) for r in d.collect())
    assert rows(N.links(v, slug, s=Settings(block_rows=5))) == rows(N.links(v, slug, s=Settings(block_rows=1000)))
    assert N.dup_positions(v.limit(0), 0.1).count() == 0 and N.dup_count(v.limit(0), 0.1).first().pairs == 0
    assert N.dup_positions(v, -1.0, Settings(block_rows=5)).agg(F.max("pos")).first()[0] == 60 * 59 // 2


def test_vectors_are_not_copied_for_each_block_that_they_meet(spark):
    """Blocks meet in a product of partitions, not as copies in a shuffle, which would grow with the square of the files."""
    import random

    from lorekeep.config import Settings

    rnd = random.Random(3)
    v = N.file_vectors(vectors(spark, {f"f{k:04}": [rnd.gauss(0, 1) for _ in range(64)] for k in range(600)}), 64)
    plans = []
    for f in (N.dup_pairs, N.dup_count, lambda *a: N.links(a[0], v.select("file", F.col("file").alias("slug")), threshold=a[1], s=a[2])):
        d = f(v, 0.9, Settings(block_rows=20))
        d.collect()
        plans.append(d._jdf.queryExecution().executedPlan().toString())
    assert all("CartesianProduct" in p and "Generate explode" not in p for p in plans)


def test_pairs_cost_few_bytes_on_their_way(spark):
    """Python gives the places of a pair, not its two names: 44 bytes a pair with them."""
    v = N.file_vectors(vectors(spark, {f"doc_{k:05}.md": [1, 0.001 * (k % 50)] for k in range(1000)}), 2)
    d = N.dup_pairs(v)
    assert len(d.collect()) == 1000 * 999 // 2

    def received(node):
        own = node.metrics().get("pythonDataReceived")
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        below = [inner] if inner is not None else [node.children().apply(k) for k in range(node.children().size())]
        return (own.get().value() if own.isDefined() else 0) + sum(map(received, below))

    assert 0 < received(d._jdf.queryExecution().executedPlan()) < 30 * 1000 * 999 // 2


def test_pairs_are_those_of_double_precision(spark):
    """Products at the threshold and halfway between two thousandths, of which single precision can't tell."""
    import numpy as np

    from lorekeep.config import Settings

    turn = [np.arccos(c) for c in (0.5500000004, 0.5499999996, 0.5499999994, 0.7005, 0.70050000001, 0.70049999999, 0.8)]
    rows = {f"f{k:03}": [np.cos(w), np.sin(w), 0] for k, w in enumerate([0, *turn])}
    rows |= {f"r{k:03}": x / np.linalg.norm(x) for k, x in enumerate(np.random.default_rng(4).normal(size=(130, 3)))}
    names, x = list(rows), np.array(list(rows.values()))
    product = np.cumsum(x[:, None, :] * x[None, :, :], axis=2)[:, :, -1]
    good = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if np.floor(product[a, b] * 1e9 + 0.5) / 1e9 >= 0.55]
    want = [(names[a], names[b], np.floor(product[a, b] * 1000 + 0.5) / 1000) for a, b in good]
    v = vectors(spark, rows).drop("ord")
    for s in (Settings(block_rows=37), Settings()):
        assert sorted((r.a, r.b, r.score) for r in N.dup_pairs(v, 0.55, s).collect()) == sorted(want)


def test_counts_of_pairs_are_stored_once_and_not_shuffled(spark, monkeypatch):
    """A row for each block and group, shuffled twice and sorted, took more disk than the vectors."""
    import random

    from lorekeep.config import Settings

    rnd, kept, stash = random.Random(5), {}, N.scratch.stash
    v = N.file_vectors(vectors(spark, {f"f{k:03}": [rnd.gauss(0, 1) for _ in range(3)] for k in range(120)}), 3)
    monkeypatch.setattr(N, "GROUP_BLOCKS", 3)
    monkeypatch.setattr(N.scratch, "stash", lambda df, name: kept.setdefault(name, stash(df, name)))
    d = N.dup_positions(v, 0.1, Settings(block_rows=5))
    n = len(d.collect())
    assert sorted(r.pos for r in d.collect()) == list(range(1, n + 1))
    assert kept["groups"].count() > 3 and kept["counts"].count() == kept["blocks"].count()
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "CartesianProduct" in plan and "RoundRobin" not in plan and "SortMergeJoin" not in plan


def test_links_are_written_once(spark):
    d = notes(spark, alpha="cats purr softly at night", beta="cats purr softly at noon", gamma="rockets fly to orbit", MEMORY="cats purr")
    vec = N.file_vectors(index(spark, d)[1], V.HASH_DIM, only_top_level=True, centered=True)
    found = N.links(vec, N.slugs(d), threshold=0.1)
    pairs = {(r.file, r.target) for r in found.collect()}
    assert ("alpha.md", "beta.md") in pairs and ("beta.md", "alpha.md") in pairs
    assert not any("MEMORY.md" in p for p in pairs)
    out = N.apply_links(d, found).collect()
    assert all(r.changed and "[[" in r.new_raw for r in out)
    again = N.apply_links(spark.createDataFrame([(r.file, r.new_raw) for r in out], "file string, raw string"), found)
    assert again.where("changed").count() == 0


def test_scores_are_rounded_by_their_binary_value(spark):
    import random

    rnd = random.Random(1)
    xs = [k / 1000 for k in range(-1250, 1251)] + [k / 8 for k in range(-12, 13)] + [rnd.uniform(-2, 2) for _ in range(2000)] + [1e-9, 1e-300, 0.005 + 2**-57]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.two_decimals(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in rows if abs(r.x) <= 1.25 and r.t != f"{r.x:.2f}"] == []
    block = spark.range(1).select(T.render_block(F.array(F.struct(F.lit("s").alias("slug"), F.lit(0.285).alias("score")))).alias("t")).first().t
    assert "- [[s]] — 0.28\n" in block


def test_stale_and_review(spark):
    rows = [("old.md", "2024-01-20"), ("edge.md", "2024-01-31"), ("new.md", "2024-02-28"), ("MEMORY.md", "2023-01-01"), ("_review.md", "2023-01-01"), ("sessions/s.md", "2023-01-01")]
    d = spark.createDataFrame([(f, datetime.fromisoformat(m)) for f, m in rows], "file string, mtime timestamp")
    found = N.stale(d, now())
    assert {r.file for r in found.collect()} == {"old.md", "edge.md"}
    lines = [r.line for r in N.review(found, spark.createDataFrame([], "a string, b string, score double")).orderBy("section", "pos").collect()]
    assert lines[0].startswith("# ") and "- `old.md` — 41.0 дн." in lines and lines[-2] == "_нет_"


def test_scan_reads_top_level_and_sessions_only(spark, tmp_path):
    for f in ("a.md", "_review.md", "b.txt", "sessions/s.md", "sessions/archive/x.md", "deep/y.md"):
        p = tmp_path / f
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x\r\ny")
    rows = S.scan_notes(spark, str(tmp_path)).collect()
    assert {r.file for r in rows} == {"a.md", "sessions/s.md"}
    assert {r.raw for r in rows} == {"x\ny"}
    assert S.scan_notes(spark, str(tmp_path / "none")).count() == 0


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state.load(spark, path, "x int").count() == 0
    state.save(spark.createDataFrame([(1,)], "x int"), path)
    state.save(state.load(spark, path, "x int").union(spark.createDataFrame([(2,)], "x int")), path)
    assert sorted(r.x for r in state.load(spark, path, "x int").collect()) == [1, 2]


def test_key_values(spark, tmp_path):
    (tmp_path / "env").write_text(" A = 1=2 \n#B=1\n\nnone\nA=3\n")
    assert {r.key: r.value for r in S.scan_key_values(spark, str(tmp_path / "env")).collect()} == {"A": "3"}


def test_maintain_is_idempotent(spark, tmp_path):
    from lorekeep.plans import maintain as M

    folder, store = tmp_path / "notes", str(tmp_path / "store")
    (folder / "sessions").mkdir(parents=True)
    for name, t in {"alpha": "cats purr softly at night", "beta": "cats purr softly at noon", "gamma": "rockets fly to orbit", "delta": "tax forms are due in april", "eps": "bread needs flour and salt", "sessions/s": "cats purr softly at night"}.items():
        (folder / f"{name}.md").write_text(t)
    first = M.maintain(spark, str(folder), store, now())
    assert first["embedded"] == 6 and first["written"] >= 2
    assert "[[beta]]" in (folder / "alpha.md").read_text() and (folder / "sessions/s.md").read_text() == "cats purr softly at night"
    assert (folder / "_review.md").read_text().startswith("# ")
    again = M.maintain(spark, str(folder), store, now())
    assert again["written"] == 0
    assert M.maintain(spark, str(folder), store, now())["embedded"] == 0
    assert M.recall(spark, store, ["rockets in orbit"], 1).first().file == "gamma.md"
