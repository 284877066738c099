"""Hook events to observations, micro-batch gates, instincts, test runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.config import DEFAULTS, Settings
from lorekeep.functions import text as T

#: The name by which hook payloads of this system's own runs are known.
OWN_NAME = "lorekeep"


def not_denied(events: DataFrame, denied: DataFrame) -> DataFrame:
    """Events whose folder is none of ``denied`` (path) and in none of them. Blank and comment lines deny nothing. Folders
    meet the list by their own prefixes, so the list may be of any size."""
    p = T.strip(F.col("path"))
    listed = denied.select(p.alias("_p")).where((F.col("_p") != "") & ~F.col("_p").startswith("#")).select(F.regexp_replace("_p", "/+$", "").alias("_p")).distinct()
    cwd = F.coalesce("cwd", F.lit(""))
    parts = F.split(cwd, "/", -1)
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = events.select("cwd").distinct().select("cwd", F.explode(F.when(cwd != "", ups).otherwise(F.array().cast("array<string>"))).alias("_p"))
    bad = folders.join(listed, "_p", "left_semi").select(F.col("cwd").alias("_bad")).distinct()
    return events.join(bad, F.col("cwd") == F.col("_bad"), "left_anti")


def observe(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """seq, timestamp, event, tool, session, input, output: a start keeps its input, a completion its output, both cut."""
    first = lambda *c: F.coalesce(*[T.truthy(F.col(x)) for x in c], F.lit("unknown"))
    start = F.col("event") == "pre"
    return events.select(
        "seq", F.date_trunc("second", "ts").alias("timestamp"), F.when(start, "tool_start").otherwise("tool_complete").alias("event"),
        first("tool_name", "tool").alias("tool"), first("session_id").alias("session"),
        F.when(start, F.substring("input", 1, s.input_chars)).alias("input"), F.when(~start, F.substring("output", 1, s.output_chars)).alias("output"),
    )


def log_lines(observed: DataFrame) -> DataFrame:
    """value: one JSON line an observation; absent fields are left out."""
    return observed.select(F.to_json(F.struct(*observed.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}).alias("value"))


def guard(payloads: DataFrame, raw: str = "raw", own: str = OWN_NAME) -> DataFrame:
    """Payloads that are empty or speak of this system itself go."""
    return payloads.where((F.col(raw) != "") & ~F.col(raw).contains(own))


def foreground(payloads: DataFrame, flags: tuple[str, ...] = ("analyzing", "background")) -> DataFrame:
    """Without those of background runs (boolean columns)."""
    for f in flags:
        payloads = payloads.where(~F.coalesce(F.col(f), F.lit(False)))
    return payloads


#: Fixed value: which handler takes which event, by a pattern on its matcher.
ROUTES = {"capture": "(?s).*", "testrun": "^Bash$", "context": "^(startup|clear)$"}


def route(events: DataFrame, matcher: str = "matcher") -> DataFrame:
    """One row for each event and handler."""
    handlers = F.array(*[F.when(F.col(matcher).rlike(p), F.lit(h)) for h, p in ROUTES.items()])
    return events.withColumn("handler", F.explode(F.filter(handlers, lambda h: h.isNotNull())))


def gated(batch: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The whole batch, or nothing if it is too small. A one-row count decides."""
    enough = batch.agg((F.count("*") >= s.least_observations).alias("_enough")).where("_enough")
    return batch.join(F.broadcast(enough), F.lit(True), "left_semi")


def byte_tail(lines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The last lines (seq, line) that fit the byte limit, whole lines only. Sums a partition's bytes first, so that no task
    sees all lines."""
    size = F.octet_length("line") + 1
    parts = 64
    lines = lines.withColumn("_size", size)
    edge = lines.agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi"))
    bucket = F.floor((F.col("seq") - F.col("_lo")) / F.greatest((F.col("_hi") - F.col("_lo") + 1) / parts, F.lit(1.0)))
    binned = lines.join(F.broadcast(edge), F.lit(True)).withColumn("_b", bucket).drop("_lo", "_hi")
    later = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    after = binned.groupBy("_b").agg(F.sum("_size").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_after")).where(F.col("_after") <= s.tail_bytes)
    within = Window.partitionBy("_b").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return binned.join(F.broadcast(after), "_b").withColumn("_sum", F.sum("_size").over(within) + F.col("_after")).where(F.col("_sum") <= s.tail_bytes).drop("_b", "_size", "_after", "_sum")


def repeated_patterns(observations: DataFrame, least: int = 3) -> DataFrame:
    """tool, shape, n, confidence: what recurs at least so often, a deterministic stand-in for a model that reads the log.
    A shape is an input with its numbers blanked; confidence is its share of the tool's calls, clamped."""
    shape = F.regexp_replace(F.coalesce("input", F.lit("")), "[0-9]+", "N")
    n = observations.where("event = 'tool_start'").groupBy("tool", shape.alias("shape")).agg(F.count("*").alias("n"))
    total = n.groupBy("tool").agg(F.sum("n").alias("_t"))
    return n.join(total, "tool").where(F.col("n") >= least).select("tool", "shape", "n", F.round(T.clamp(F.col("n") / F.col("_t"), 0.3, 0.9), 2).alias("confidence"))


def merge_instincts(known: DataFrame, proposed: DataFrame, today: Column) -> DataFrame:
    """Known instincts (id, confidence DECIMAL(4,2), trigger, domain, title, action, evidence, last_observed) after ``proposed``
    (seq and texts) are applied in order: a repeat raises confidence, contents replace contents, a new id needs some.
    Repeats of an id within the batch are one fold; confidence is kept to two decimals at each step."""
    conf = T.clamp(F.coalesce(F.nullif(F.col("confidence").try_cast("double"), F.lit(0.0)), F.lit(0.3)), 0.3, 0.9)
    some = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    pid = T.slug_id(F.coalesce(T.truthy(F.col("id")), F.col("title")))
    row = F.struct("seq", conf.alias("conf"), ((some("action") != "") | (some("trigger") != "")).alias("full"), F.replace(some("trigger"), F.lit('"'), F.lit("'")).alias("trigger"), T.slug_id(F.coalesce(T.truthy(F.col("domain")), F.lit("general"))).alias("domain"), T.truthy(some("title")).alias("title"), some("action").alias("action"), some("evidence").alias("evidence"))
    batch = proposed.withColumn("_row", row).groupBy(pid.alias("_pid")).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    fields = ("trigger", "domain", "title", "action", "evidence")
    both = known.withColumn("_known", F.lit(True)).join(batch, F.col("id") == F.col("_pid"), "full").withColumn("_id", F.coalesce("id", "_pid"))
    two = lambda c: c.cast("decimal(4,2)").cast("double")
    start = F.struct(F.coalesce("_known", F.lit(False)).alias("have"), F.lit(False).alias("touched"), F.col("confidence").cast("double").alias("conf"), *[F.col(f) for f in fields])

    def step(a: Column, p: Column) -> Column:
        skip = ~a["have"] & ~p["full"]
        bumped = two(F.round(T.clamp(F.greatest(a["conf"], p["conf"]) + 0.05, 0.3, 0.9), 2))
        fresh = {f: p[f] for f in fields} | {"title": F.coalesce(p["title"], T.title_default(F.col("_id")))}
        return F.struct(
            (a["have"] | p["full"]).alias("have"), (a["touched"] | ~skip).alias("touched"),
            F.when(skip, a["conf"]).when(a["have"], bumped).otherwise(two(F.round(p["conf"], 2))).alias("conf"),
            *[F.when(p["full"], fresh[f]).otherwise(a[f]).alias(f) for f in fields],
        )

    done = both.withColumn("_a", F.aggregate(F.coalesce("_rows", F.array().cast(batch.schema["_rows"].dataType)), start, step)).where("_a.have")
    return done.select(F.col("_id").alias("id"), F.col("_a.conf").cast("decimal(4,2)").alias("confidence"), *[F.col(f"_a.{f}").alias(f) for f in fields], F.when(F.col("_a.touched"), today).otherwise(F.col("last_observed")).alias("last_observed"))


INSTINCT = "id string, confidence decimal(4,2), trigger string, domain string, title string, action string, evidence string, last_observed date"


def render_instinct(found: DataFrame) -> DataFrame:
    """file, raw of every instinct."""
    c = lambda x: F.col(x).cast("string")
    raw = F.concat(F.lit("---\nid: "), "id", F.lit('\ntrigger: "'), "trigger", F.lit('"\nconfidence: '), c("confidence"), F.lit("\ndomain: "), "domain", F.lit("\nsource: session-observation\nlast_observed: "), c("last_observed"), F.lit("\n---\n\n# "), "title", F.lit("\n\n## Action\n"), "action", F.lit("\n\n## Evidence\n"), "evidence", F.lit("\n"))
    return found.select(F.concat("id", F.lit(".md")).alias("file"), raw.alias("raw"))


def bump(raw: Column, confidence: Column, today: Column) -> Column:
    """The card's text with its first confidence and date line replaced."""
    once = lambda t, key, v: F.regexp_replace(t, rf"(?s)\A(.*?)(?m:^{key}:[^\n]*$)", F.concat(F.lit("$1"), F.lit(f"{key}: "), v))
    return once(once(raw, "confidence", confidence.cast("string")), "last_observed", today.cast("string"))


def cards(files: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """file, confidence, card of the instincts (file, raw) that are trusted enough."""
    body = F.coalesce(F.get(F.split("raw", "---", 3), F.lit(2)), F.col("raw"))
    label = F.coalesce(T.truthy(T.strip(F.regexp_extract(body, r"(?dm)^# (.+)$", 1))), F.regexp_replace("file", r"\.md$", ""))
    first = F.coalesce(F.get(F.filter(F.transform(F.split(body, "\n", -1), lambda x: T.strip(x)), lambda x: (x != "") & ~x.startswith("#")), F.lit(0)), F.lit(""))
    conf = F.coalesce(T.parse_confidence(F.col("raw")), F.lit(0.0))
    return files.select("file", conf.alias("confidence"), F.concat(F.format_string("- (%.2f) **", conf), label, F.lit("** — "), first).alias("card")).where(F.col("confidence") >= s.confidence)


def top_cards(files: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return cards(files, s).orderBy(F.desc("confidence"), "file").limit(s.shown_instincts)


def trigger_of(raw: Column) -> Column:
    return F.substring(F.regexp_extract(raw, r'(?dm)^trigger:\s*"?(.*?)"?\s*$', 1), 1, 90)


def run_result(cmd: Column, output: Column) -> Column:
    """What a test command's output says; null if nothing. The first pattern that fits decides."""
    out = T.unescape_newlines(output)
    # The patterns of two test runners' summaries.
    done = r"(\d+) tests? completed, (\d+) failed(?:, (\d+) skipped)?"
    passed = r"(?:(\d+) failed, )?(\d+) passed(?:, (\d+) skipped)?(?:, \d+ warning)?"
    g = lambda p, k: F.regexp_extract(out, p, k)
    num = lambda p, k: F.coalesce(T.truthy(g(p, k)).cast("long"), F.lit(0))
    text = lambda c: c.cast("string")
    gradle = cmd.contains("gradlew") & cmd.contains("test")
    any_passed, any_failed = out.rlike(passed), out.rlike(r"(\d+) failed")
    failed = F.when(any_passed, num(passed, 1)).otherwise(num(r"(\d+) failed", 1))
    ok = F.when(any_passed, num(passed, 2)).otherwise(F.lit(0).cast("long"))
    # Fixed value: the wording of results.
    return (
        F.when(out.rlike(done), F.concat(text(num(done, 1)), F.lit(" тестов: "), text(num(done, 1) - num(done, 2)), F.lit(" ok, "), text(num(done, 2)), F.lit(" FAILED"), F.when(g(done, 3) != "", F.concat(F.lit(", "), g(done, 3), F.lit(" skip"))).otherwise("")))
        .when(cmd.contains("pytest") & (any_passed | any_failed), F.concat(F.lit("pytest: "), text(ok), F.lit(" ok"), F.when(failed > 0, F.concat(F.lit(", "), text(failed), F.lit(" FAILED"))).otherwise("")))
        .when(~cmd.contains("pytest") & gradle & out.contains("BUILD SUCCESSFUL"), "gradle test: зелёный (BUILD SUCCESSFUL)")
        .when(gradle & out.contains("BUILD FAILED") & out.contains("Compilation"), "gradle: НЕ СКОМПИЛИРОВАЛОСЬ")
    )


def repo_name(cwd: Column, override: Column | None = None) -> Column:
    base = T.base_name(cwd)
    return base if override is None else F.coalesce(T.truthy(override), base)


def test_runs(payloads: DataFrame) -> DataFrame:
    """seq, repo, line of the payloads (seq, ts, cwd, cmd, output) that hold a result."""
    result = run_result(F.col("cmd"), F.col("output"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" | "), "result", F.lit(" | "), T.cmd_short(F.col("cmd")))
    return payloads.withColumn("result", result).where("result IS NOT NULL").select("seq", repo_name(F.col("cwd")).alias("repo"), line.alias("line"))


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    """The last n rows of each repo."""
    nth = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("seq")))
    return runs.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def context_runs(names: DataFrame, runs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """name, seq, line: the last runs of each resolved name, in order; names without any appear once with nulls."""
    return names.join(latest_runs(runs, s.shown_runs).withColumnRenamed("repo", "name"), "name", "left")


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """key, value: the right side wins."""
    return base.select("key", F.col("value").alias("_a")).join(over.select("key", F.col("value").alias("_b"), F.lit(True).alias("_has")), "key", "full").select("key", F.when(F.col("_has"), F.col("_b")).otherwise(F.col("_a")).alias("value"))


def first_backend(settings: DataFrame, order: list[str]) -> DataFrame:
    """key of the first setting in ``order`` that isn't empty."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("key"))
    return settings.where((F.coalesce("value", F.lit("")) != "") & (rank > 0)).orderBy(rank).limit(1).select("key")
