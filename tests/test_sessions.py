import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorekeep.operators import journal as J
from lorekeep.operators import observations as O
from lorekeep.operators import transcripts as R

NOW = datetime(2024, 3, 1)


def lines(spark, *records):
    return spark.createDataFrame([("s", k, x if isinstance(x, str) else json.dumps(x)) for k, x in enumerate(records)], "session string, line_no long, line string")


def user(text, **more):
    return {"type": "user", "message": {"content": text}, **more}


def assistant(*blocks, **more):
    return {"type": "assistant", "message": {"content": list(blocks)}, **more}


def test_noise_is_skipped(spark):
    d = lines(spark, "", "{bad", "[1]", user("hi"), {"type": "other"})
    assert R.records(d).count() == 2


def test_prompts(spark):
    d = lines(spark, user("  hi "), user("<command-name>x"), user("Caveat: y"), user("   "), user("meta", isMeta=True), user([{"type": "tool_result", "content": "r"}]))
    b = R.blocks(d).orderBy("line_no").collect()
    assert [(r.kind, r.text) for r in b] == [("USER", "hi"), ("RESULT", None)]


def test_tools(spark):
    use = lambda name, given: {"type": "tool_use", "name": name, "input": given}
    d = lines(spark, assistant(use("Bash", {"x": 1, "command": "ls  -l"}), use("TodoWrite", {"a": 1}), use("New", {"z": 5, "a": 1}), use("Read", {}), {"type": "tool_use", "input": {"k": "v"}}, {"type": "text", "text": " "}, {"type": "thinking"}))
    b = R.blocks(d).where("kind = 'TOOL'").orderBy("pos").collect()
    assert [r.text for r in b] == ["Bash(ls -l)", "TodoWrite", "New(z=5)", "Read", "tool(k=v)"]
    c = R.counts(R.blocks(d)).first()
    assert (c.tool_calls, c.thinking, c.assistant_texts) == (5, 1, 0)


def test_metadata_and_times_follow_the_file(spark):
    d = lines(spark, {"type": "user", "timestamp": "2024-03-01T10:05:00Z", "gitBranch": "a"}, {"type": "x", "timestamp": "2024-03-01T09:00:00Z", "cwd": "/no"}, {"type": "assistant", "cwd": "/w", "gitBranch": "b"}, {"type": "user", "cwd": "/later", "gitBranch": "c", "timestamp": "2024-03-01T10:01:00Z"})
    s = R.sessions(d).first()
    assert (s.first_ts, s.last_ts, s.cwd, s.gitBranch) == ("2024-03-01T10:05:00Z", "2024-03-01T10:01:00Z", "/w", "b")


def test_digest_needs_two_prompts(spark):
    assert R.digest(lines(spark, user("one"))).count() == 0
    text = R.digest(lines(spark, user("one", timestamp="2024-03-01T10:00:00Z"), assistant({"type": "text", "text": "yes"}), user("two", timestamp="2024-03-01T11:01:30Z"))).first().digest
    assert text.endswith("🧑 ЮЗЕР: one\n🤖: yes\n🧑 ЮЗЕР: two") and "(~1ч 1м)" in text


def listing(spark, *rows):
    return spark.createDataFrame([(p, size, NOW - timedelta(minutes=age), raw) for p, size, age, raw in rows], "path string, size long, mtime timestamp, raw string")


def test_sweep_edges(spark):
    f = listing(spark, ("new", 1, 15, ""), ("busy", 1, 14, ""), ("grown", 4000, 20, ""), ("same", 3999, 20, ""), ("own", 500_000, 20, "HARVEST_INTERNAL_v1"), ("big", 500_001, 20, "HARVEST_INTERNAL_v1"), ("shrunk", 10, 20, ""))
    state = spark.createDataFrame([(p, 2000, "ok") for p in ("grown", "same", "shrunk")], "path string, size long, res string")
    now = F.lit(NOW)
    assert {r.path for r in J.sweep(f, state, now).collect()} == {"new", "grown", "big"}
    many = listing(spark, *[(f"p{k}", 1, 20 + k, "") for k in range(9)])
    after = J.run_sweep(many, state.limit(0), now, lambda paths: {p: "ok" for p in paths if p != "p0"})
    assert {r.path for r in after.collect()} == {f"p{k}" for k in range(1, 7)}


def entry(sid, seq, project="p", summary="x"):
    return (project, sid, "2024-03-01", "5м", summary, seq)


def test_journal_keeps_fifteen_and_moves_to_front(spark):
    old = spark.createDataFrame([entry(f"s{k}", k) for k in range(15)], J.ENTRY)
    kept, over = J.upsert(old, spark.createDataFrame([entry("s0", 100), entry("new", 101)], J.ENTRY))
    assert [r.sid for r in kept.orderBy(F.desc("seq")).limit(2).collect()] == ["new", "s0"]
    assert kept.count() == 15 and [r.sid for r in over.collect()] == ["s1"]
    same, none = J.upsert(kept, spark.createDataFrame([entry("new", 101)], J.ENTRY))
    assert sorted(map(str, same.collect())) == sorted(map(str, kept.collect())) and none.count() == 0


def test_rendered_journal_reads_back(spark):
    kept = spark.createDataFrame([entry("a", 1, summary="one\ntwo"), entry("b", 2, summary="")], J.ENTRY)
    docs = J.render(kept, spark.createDataFrame([("p", " now ")], "project string, current_state string"))
    assert [(r.sid, r.body) for r in J.parse(docs).orderBy("pos").collect()] == [("b", ""), ("a", "one\ntwo")]
    assert [r.line for r in J.state_block(docs).orderBy("n").collect()][:2] == ["## 🔖 Текущее состояние", "now"]


def test_longest_prefix(spark):
    names = spark.createDataFrame([("abc-x",), ("abc",), ("zz",)], "name string")
    slugs = spark.createDataFrame([("a",), ("abc",), ("ab",)], "slug string")
    assert {r.name: r.slug for r in J.longest_prefix(names, slugs).collect()} == {"abc-x": "abc", "abc": "abc", "zz": None}


def test_denylist_is_by_folder(spark):
    e = spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/a/bc",), ("",), (None,)], "cwd string")
    deny = spark.createDataFrame([("/a/b/",), ("# /a",), ("",)], "path string")
    assert {r.cwd for r in O.not_denied(e, deny).collect()} == {"/a/bc", "", None}


def merge(spark, known, *proposed):
    schema = "seq long, id string, title string, trigger string, confidence string, domain string, action string, evidence string"
    k = spark.createDataFrame(known, "id string, c string").select("id", F.col("c").cast("decimal(4,2)").alias("confidence"), *[F.lit("o").alias(x) for x in ("trigger", "domain", "title", "action", "evidence")], F.lit("2020-01-01").cast("date").alias("last_observed"))
    out = O.merge_instincts(k, spark.createDataFrame([(n, *p, None, None, None, None) if len(p) == 4 else (n, *p) for n, p in enumerate(proposed)], schema), F.lit("2024-03-01").cast("date"))
    return {r.id: (float(r.confidence), r.action, str(r.last_observed)) for r in out.collect()}


def p(id, confidence, action):
    return (id, None, None, confidence, None, action, None)


def test_instincts(spark):
    got = merge(spark, [("a", "0.50"), ("kept", "0.70")], p("A", "0.6", ""), p("new", "1.5", "do"), p("empty", "0.5", ""), p("bad", "x", "do"), p("bad", None, ""), p("bad", "0.2", "again"))
    assert got["a"] == (0.65, "o", "2024-03-01")
    assert got["kept"] == (0.7, "o", "2020-01-01")
    assert got["new"][:2] == (0.9, "do") and "empty" not in got
    assert got["bad"][:2] == (0.4, "again")


def test_cards(spark):
    f = spark.createDataFrame([("a.md", "---\nconfidence: 0.50\n---\n\n# T\n\n## A\nfirst\n"), ("b.md", "no confidence"), ("c.md", "---\nconfidence: 0.49\n---\n")], "file string, raw string")
    assert [(r.file, r.card) for r in O.top_cards(f).collect()] == [("a.md", "- (0.50) **T** — first")]


def test_run_results(spark):
    rows = [("x", "12 tests completed, 2 failed, 1 skipped"), ("pytest", "5 passed, 2 failed"), ("pytest", "1 failed, 3 passed"), ("pytest", "2 failed"), ("./gradlew test", "BUILD SUCCESSFUL"), ("./gradlew test", "BUILD FAILED Compilation"), ("ls", "5 passed"), ("pytest", "nothing")]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, cmd string, output string")
    got = [r.r for r in d.select("k", O.run_result(F.col("cmd"), F.col("output")).alias("r")).orderBy("k").collect()]
    assert got == ["12 тестов: 10 ok, 2 FAILED, 1 skip", "pytest: 5 ok", "pytest: 3 ok, 1 FAILED", "pytest: 0 ok, 2 FAILED", "gradle test: зелёный (BUILD SUCCESSFUL)", "gradle: НЕ СКОМПИЛИРОВАЛОСЬ", None, None]
    runs = spark.createDataFrame([(k, "r", f"l{k}") for k in range(31)], "seq long, repo string, line string")
    assert O.latest_runs(runs, 30).agg(F.min("seq")).first()[0] == 1


def test_gate_and_tail(spark):
    d = spark.range(9).withColumnRenamed("id", "seq")
    assert O.gated(d).count() == 0 and O.gated(spark.range(10)).count() == 10
    rows = spark.createDataFrame([(k, "x" * 999) for k in range(500)], "seq long, line string")
    assert sorted(r.seq for r in O.byte_tail(rows).collect()) == list(range(380, 500))
    assert O.byte_tail(rows.limit(0)).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    from lorekeep.plans import adapters as A
    from lorekeep.sources import state
    from lorekeep.streaming import hooks as H

    events = A.hook_events(spark, "/root/testdata/sf0.001")
    deny = spark.createDataFrame([("/w/click",)], "path string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.where("seq < 500").write.parquet(src)
    H.ingest(spark, src, out, str(tmp_path / "c1"), deny).awaitTermination()
    events.where("seq >= 500").write.mode("append").parquet(src)
    H.ingest(spark, src, out, str(tmp_path / "c1"), deny).awaitTermination()
    want = O.observe(O.not_denied(events, deny))
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, want.collect()))

    seen = []
    few = str(tmp_path / "few")
    want.limit(4).write.parquet(few)
    run = lambda: H.distill(spark, few, str(tmp_path / "pending"), str(tmp_path / "c2"), lambda d: seen.append(d.count())).awaitTermination()
    run()
    assert seen == []
    want.where("seq > 900").limit(8).write.mode("append").parquet(few)
    run()
    assert seen == [12]

    runs = A.run_outputs(spark, "/root/testdata/sf0.001")
    src = str(tmp_path / "runs")
    runs.repartition(3).write.parquet(src)
    H.keep_runs(spark, src, str(tmp_path / "log"), str(tmp_path / "c3")).awaitTermination()
    kept = state.load(spark, str(tmp_path / "log"), "seq long, repo string, line string")
    assert sorted(map(str, kept.collect())) == sorted(map(str, O.latest_runs(O.test_runs(runs), 30).collect()))
