"""Files and tables that are replaced, appended to and read back, also when a run stops between two steps."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import vectors as V
from lorekeep.operators import journal as J
from lorekeep.operators import notes as N
from lorekeep.sources import files, lock, state
from lorekeep.sources import notes as S


def test_a_file_is_old_or_new(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.md"
    files.replace(spark, str(path), [b"one"])
    files.replace(spark, str(path), [b"two", b" three"])
    assert path.read_bytes() == b"two three"

    def stop(*_):
        raise OSError("stopped")

    monkeypatch.setattr(files, "move", stop)
    with pytest.raises(OSError, match="stopped"):
        files.replace(spark, str(path), [b"four"])
    assert path.read_bytes() == b"two three"


def test_state_is_old_or_new_and_keeps_two_versions(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "s"), lambda n: spark.createDataFrame([(n,)], "x int")
    for n in range(4):
        state.save(rows(n), path)
    assert [r.x for r in state.load(spark, path, "x int").collect()] == [3]
    assert len(list((tmp_path / "s").glob("v=*"))) == state.KEPT

    def stop(*_):
        raise OSError("stopped")

    monkeypatch.setattr(files, "replace", stop)
    with pytest.raises(OSError, match="stopped"):
        state.save(rows(9), path)
    assert [r.x for r in state.load(spark, path, "x int").collect()] == [3]
    (tmp_path / "s" / "current.txt").write_text("")
    with pytest.raises(ValueError, match="no complete version"):
        state.load(spark, path, "x int")


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    out = str(tmp_path / "out")
    for batch, lo, hi in ((0, 0, 5), (1, 5, 9), (1, 5, 9), (0, 0, 5)):
        files.put_batch(spark.range(lo, hi), out, batch)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(9))


def test_notes_are_replaced_by_executors(spark, tmp_path):
    (tmp_path / "a b.md").write_text("old\n")
    rows = [("a b.md", "new\nlines\n"), ("ü=1.md", "x\n")]
    S.write_notes(spark.createDataFrame(rows, "file string, raw string"), str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.iterdir() if p.suffix == ".md"} == dict(rows)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_new")]
    S.write_notes(spark.createDataFrame([], "file string, raw string"), str(tmp_path))


def test_a_full_log_moves_to_the_archive(spark, tmp_path):
    folder, lines = str(tmp_path / "log"), lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert files.read_rotated(spark, folder).count() == 0
    moved = [files.append_rotated(lines(*x), folder, 8, "t") for x in (["abc"], ["def"], ["ghi"], ["jkl"])]
    assert moved == [False, False, True, False]
    got = sorted((r.value, r.archived) for r in files.read_rotated(spark, folder).collect())
    assert got == [("abc", True), ("def", True), ("ghi", False), ("jkl", False)]


def test_what_overflows_is_appended(spark, tmp_path):
    entries = lambda lo, hi: spark.createDataFrame([("p", f"s{k}", "d", "1м", f"text {k}", k) for k in range(lo, hi)], J.ENTRY)
    journal, folder = entries(0, 0), str(tmp_path / "archive")
    for lo, hi in ((0, 16), (16, 20)):
        journal, over = J.upsert(journal, entries(lo, hi))
        J.append_archive(over, folder)
    assert sorted(r.seq for r in journal.collect()) == list(range(5, 20))
    assert sorted(r.sid for r in spark.read.json(folder).collect()) == ["s0", "s1", "s2", "s3", "s4"]


def test_listing_has_sizes_and_times(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.jsonl").write_text("12345")
    (tmp_path / "p" / "x.txt").write_text("1")
    rows = files.listing(spark, f"{tmp_path}/*/*.jsonl").collect()
    assert [(r.path.rsplit("/", 1)[1], r["size"]) for r in rows] == [("x.jsonl", 5)] and rows[0].mtime is not None


def test_positions_are_those_of_one_sort(spark):
    rows = [(k % 7 / 10, f"f{k * 37 % 100:02d}") for k in range(100)]
    d = spark.createDataFrame(rows, "score double, file string")
    got = {r.file: r.pos for r in N.positions(d, [F.desc("score"), F.col("file")], F.col("score")).collect()}
    want = sorted(range(100), key=lambda k: (-rows[k][0], rows[k][1]))
    assert got == {rows[k][1]: n + 1 for n, k in enumerate(want)}
    assert N.positions(d.limit(0), [F.col("file")], F.col("score")).collect() == []


def test_many_queries_run_in_blocks(spark):
    from lorekeep.config import Settings

    rng = np.random.default_rng(0)
    found = spark.createDataFrame([(f"f{k}", k, rng.normal(size=3).tolist()) for k in range(50)], "file string, ord int, vec array<double>")
    queries = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(9)], "query int, qvec array<double>")
    rows = lambda s: sorted((r.query, r["rank"], r.file) for r in N.recall(found, queries, 4, s).collect())
    assert rows(Settings(block_queries=2)) == rows(Settings()) and len(rows(Settings())) == 36


def test_an_embedder_of_ones_own(spark):
    d = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "k int, t string")
    sizes = lambda texts: np.array([[len(t), 1.0] for t in texts]) * [len(texts) > 0, 0]
    got = {r.k: r.vec for r in V.injected(sizes, "q: ")(d, ["k"], "t").collect()}
    assert got == {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [1.0, 0.0]}
    zero = V.injected(lambda texts: np.zeros((len(texts), 2)))
    assert zero(d, ["k"], "t").first().vec == [0.0, 0.0] and zero(d.limit(0), ["k"], "t").collect() == []


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from lorekeep import cli

    folder, store = tmp_path / "notes", str(tmp_path / "store")
    folder.mkdir()
    for name, text in {"cats": "cats purr softly at night\n", "rockets": "rockets fly to orbit\n", "bread": "bread needs flour\n"}.items():
        (folder / f"{name}.md").write_text(text)
    run = lambda *a: (cli.main([*a, "--folder", str(folder), "--store", store]), capsys.readouterr().out)[1]
    assert "'chunks': 3" in run("index")
    assert "rockets.md" in run("recall", "rockets", "in", "orbit", "-k", "1")
    assert "# " in run("lifecycle")
    assert json.loads(run("link").replace("'", '"'))["written"] >= 0
    edges = [x.split("\t") for x in run("graph").splitlines()]
    assert all(len(e) == 3 and e[0] != e[1] and float(e[2]) >= 0.25 for e in edges)
    assert "'embedded'" in run("maintain")
    (tmp_path / "store" / "disabled").touch()
    assert "nothing done" in run("maintain")


def test_one_run_at_a_time(spark, tmp_path):
    folder = str(tmp_path)
    held = tmp_path / lock.LOCK
    with lock.exclusive(spark, folder, 20) as first:
        assert first and held.exists()
        with lock.exclusive(spark, folder, 20) as second:
            assert not second
        assert held.exists()  # the refused run leaves the other's lock
        os.utime(held, (time.time() - 21 * 60,) * 2)
        with lock.exclusive(spark, folder, 20) as third:
            assert third  # one that was left behind doesn't hold
            with lock.exclusive(spark, folder, 20) as fourth:
                assert not fourth
    assert not held.exists()
    with pytest.raises(ValueError, match="stopped"), lock.exclusive(spark, folder, 20):
        raise ValueError("stopped")
    assert not [f for f in tmp_path.iterdir() if lock.LOCK in f.name and not f.name.startswith(".")]
    (tmp_path / lock.DISABLED).touch()
    with lock.exclusive(spark, folder, 20) as free:
        assert not free and not held.exists()
