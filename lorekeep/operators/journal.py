"""The session journal: which transcripts to harvest, upserts, retention, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.config import DEFAULTS, Settings
from lorekeep.functions import text as T

ENTRY = "project string, sid string, date string, dur string, summary string, seq long"


def eligible(files: DataFrame, state: DataFrame, now: Column, s: Settings = DEFAULTS) -> DataFrame:
    """Transcripts that are idle for long enough and new, or have grown enough, since the state was saved."""
    seen = state.select("path", F.col("size").alias("_seen"))
    idle = F.unix_micros(now) - F.unix_micros("mtime") >= s.idle_minutes * 60_000_000
    grown = F.col("_seen").isNull() | (F.col("size") - F.col("_seen") >= s.least_growth)
    return files.where(idle).join(seen, "path", "left").where(grown).drop("_seen")


def own_output(size: Column, raw: Column, s: Settings = DEFAULTS) -> Column:
    """Files of bounded size that hold the sentinel are this system's own."""
    return (size <= s.sentinel_bytes) & F.coalesce(raw.contains(s.sentinel), F.lit(False))


def sweep(files: DataFrame, state: DataFrame, now: Column, failed: list[str] | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """The newest eligible transcripts, so many a run; ``failed``: paths that this run has tried in vain."""
    found = eligible(files, state, now, s).where(~own_output(F.col("size"), F.col("raw"), s))
    if failed:
        found = found.where(~F.col("path").isin(failed))
    return found.orderBy(F.desc("mtime"), "path").limit(s.most_per_sweep)


def run_sweep(files: DataFrame, state: DataFrame, now: Column, harvest, s: Settings = DEFAULTS) -> DataFrame:
    """The state after one run. ``harvest(paths)`` gives {path: result}, without those that failed; they are tried again in
    a later run, and others take their place in this one. At most ``most_per_sweep`` paths reach the driver at a time."""
    done: dict[str, tuple[int, str]] = {}
    failed: list[str] = []
    while len(done) < s.most_per_sweep:
        rows = sweep(files, state, now, [*failed, *done], s).limit(s.most_per_sweep - len(done)).select("path", "size").collect()
        if not rows:
            break
        results = harvest([r.path for r in rows])
        done |= {r.path: (r.size, results[r.path]) for r in rows if r.path in results}
        failed += [r.path for r in rows if r.path not in results]
    new = state.sparkSession.createDataFrame([(p, n, res) for p, (n, res) in done.items()], "path string, size long, res string")
    return state.select("path", "size", "res").join(new, "path", "left_anti").unionByName(new)


def upsert(journal: DataFrame, new: DataFrame, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(journal, overflow): new entries replace those of the same project and sid and come first; the newest stay. Of
    repeated keys in ``new`` the last one counts."""
    last = new.groupBy("project", "sid").agg(F.max_by(F.struct("date", "dur", "summary", "seq"), "seq").alias("e")).select("project", "sid", "e.date", "e.dur", T.strip(F.col("e.summary")).alias("summary"), "e.seq")
    both = journal.join(last, ["project", "sid"], "left_anti").unionByName(last)
    ranked = both.withColumn("_nth", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("seq"), "sid")))
    return ranked.where(F.col("_nth") <= s.journal_entries).drop("_nth"), ranked.where(F.col("_nth") > s.journal_entries).drop("_nth")


def append_archive(overflow: DataFrame, folder: str) -> None:
    """Add entries to the archive; it is never read by this system, and an entry that overflows twice stands there twice."""
    overflow.write.mode("append").partitionBy("project").json(folder)


def render(journal: DataFrame, states: DataFrame) -> DataFrame:
    """project, doc: the whole session document."""
    entry = F.concat(F.lit("\n### "), "date", F.lit(" · "), "sid", F.lit(" · "), "dur", F.when(F.col("summary") != "", F.concat(F.lit("\n"), "summary")).otherwise(""))
    body = journal.groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", entry.alias("t"))), asc=False), lambda x: x["t"]), "\n").alias("entries"))
    # Fixed value: the document's head.
    head = F.concat(F.lit("# Сессии: "), "project", F.lit("\n<!-- AUTO-HARVEST (launchd-свипер). Канон recall. Руками не править — перезапишется. -->\n\n## 🔖 Текущее состояние\n"), T.strip(F.coalesce("current_state", F.lit(""))), F.lit("\n\n## Журнал\n"))
    return body.join(states, "project", "left").select("project", F.concat(head, "entries", F.lit("\n")).alias("doc"))


def parse(docs: DataFrame) -> DataFrame:
    """project, pos, sid, header, body of the entries in (project, doc): order keeps repeats, the last body of a sid wins."""
    after = F.substr("doc", F.locate("## Журнал", "doc") + F.length(F.lit("## Журнал")))
    parts = F.when(F.col("doc").contains("## Журнал"), F.split(after, "\n### ", -1))
    rows = docs.select("project", F.posexplode(parts).alias("pos", "part")).where("pos > 0")
    line, rest = F.substring_index("part", "\n", 1), F.regexp_replace("part", r"\A[^\n]*\n?", "")
    tokens = F.transform(F.split(line, "·"), lambda t: T.strip(t))
    sid = F.coalesce(F.get(tokens, F.lit(1)), T.strip(line))
    out = rows.select("project", "pos", sid.alias("sid"), F.concat(F.lit("### "), T.strip(line)).alias("header"), T.rstrip(rest).alias("body"))
    last = Window.partitionBy("project", "sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.select("project", "pos", "sid", F.last("header").over(last).alias("header"), F.last("body").over(last).alias("body"))


def state_block(docs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """project, n, line: from the state heading up to the journal heading, at most so many lines."""
    rows = docs.select("project", F.posexplode(F.split("doc", "\n", -1)).alias("pos", "line"))
    mark = F.when(F.col("line").rlike("^## 🔖"), F.lit(True)).when(F.col("line").rlike("^## Журнал"), F.lit(False))
    run = F.last(mark, ignorenulls=True).over(Window.partitionBy("project").orderBy("pos"))
    inside = rows.withColumn("_in", run).where("_in")
    return inside.withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("pos"))).where(F.col("n") <= s.state_lines).select("project", "n", "line")


def longest_prefix(names: DataFrame, slugs: DataFrame) -> DataFrame:
    """name, slug: the longest slug that the name starts with, an equal one being the longest; null if there is none. Slugs
    meet names by their lengths' prefixes, an equi-join, instead of a comparison of all with all."""
    lengths = slugs.select(F.length("slug").alias("_n")).distinct().agg(F.array_sort(F.collect_list("_n")).alias("_ns"))
    keyed = names.join(F.broadcast(lengths), F.lit(True)).select("name", F.explode_outer(F.filter("_ns", lambda n: n <= F.length("name"))).alias("_n")).select("name", F.substr("name", F.lit(1), F.col("_n")).alias("_key"))
    hit = keyed.join(slugs.select("slug").distinct(), F.col("_key") == F.col("slug"), "left")
    return hit.groupBy("name").agg(F.max_by("slug", F.length("slug")).alias("slug"))


def recent_projects(files: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return files.orderBy(F.desc("mtime"), "path").limit(s.shown_projects)
