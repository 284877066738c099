"""Session transcripts: JSON lines to events, counters, metadata and a digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.config import DEFAULTS, Settings
from lorekeep.functions import text as T

# Which input field a tool is shown by (no field: its name alone), and service texts that are no prompts.
TOOL_KEY = {
    "Bash": "command", "Read": "file_path", "Edit": "file_path", "Write": "file_path", "Grep": "pattern", "Glob": "pattern",
    "Task": "description", "WebFetch": "url", "WebSearch": "query", "Skill": "skill",
}
NAME_ONLY = ("TodoWrite",)
SERVICE = r"^(<local-command|<command-|<bash-|Caveat:)"
TEXT_CHARS, ARGUMENT_CHARS = 400, 140


def records(lines: DataFrame) -> DataFrame:
    """session, line_no, line and the fields that are read. Blank and malformed lines go, and so do lines that aren't objects."""
    v = F.try_parse_json("line")
    kept = lines.withColumn("v", v).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "string").alias(name)
    return kept.select("session", "line_no", "line", *map(field, ("type", "timestamp", "cwd", "gitBranch", "version", "sessionId")), F.coalesce(F.try_variant_get("v", "$.isMeta", "boolean"), F.lit(False)).alias("isMeta"))


def user_text(content: Column) -> Column:
    """A prompt's text, stripped; null if it is empty or of the service kind."""
    t = T.strip(content)
    return F.when((t != "") & ~t.rlike(SERVICE), t)


def tool_line(name: Column, given: Column) -> Column:
    """The tool with its most telling argument. ``given``: its input as JSON text, whose first field stands in."""
    keys = F.create_map(*[F.lit(x) for pair in TOOL_KEY.items() for x in pair])
    fields = F.from_json(given, "map<string,string>")
    value = F.try_element_at(fields, F.coalesce(F.try_element_at(keys, name), F.lit("_")))
    first = F.get(F.json_object_keys(given), F.lit(0))
    shown = F.coalesce(value, F.concat(first, F.lit("="), F.coalesce(F.try_element_at(fields, first), F.lit("None"))))
    falsy = F.coalesce(shown, F.lit("")).isin("", "0", "false", "[]", "{}")
    return F.when(name.isin(*NAME_ONLY) | falsy, name).otherwise(F.concat(name, F.lit("("), T.ws_clip(shown, ARGUMENT_CHARS), F.lit(")")))


def blocks(lines: DataFrame) -> DataFrame:
    """session, line_no, pos, ts, kind, text, tool: every prompt, text, tool call, and the thinking and results that only count."""
    r = records(lines).where(F.col("type").isin("user", "assistant"))
    # content is text or a list of blocks
    content = F.get_json_object("line", "$.message.content")
    is_list = F.coalesce(F.schema_of_variant(F.try_parse_json(content)).startswith("ARRAY"), F.lit(False)) & content.startswith("[")
    quoted = F.try_variant_get(F.try_parse_json("line"), "$.message.content", "string")
    wide = r.withColumn("_list", F.when(is_list, F.from_json(content, "array<string>"))).withColumn("_text", F.when(F.col("_list").isNull(), quoted))
    prompts = wide.where((F.col("type") == "user") & ~F.col("isMeta") & F.col("_text").isNotNull()).select("session", "line_no", F.lit(0).alias("pos"), F.col("timestamp").alias("ts"), F.lit("USER").alias("kind"), user_text(F.col("_text")).alias("text"), F.lit(None).cast("string").alias("tool")).where("text IS NOT NULL")
    each = wide.where("_list IS NOT NULL").select("session", "line_no", "timestamp", "type", F.posexplode("_list").alias("pos", "b"))
    get = lambda path: F.get_json_object("b", path)
    kind = get("$.type")
    assistant = F.col("type") == "assistant"
    name = F.coalesce(get("$.name"), F.lit("tool"))
    what = (
        F.when(assistant & (kind == "thinking"), "THINKING")
        .when(assistant & (kind == "text"), "ASSISTANT")
        .when(assistant & (kind == "tool_use"), "TOOL")
        .when(~assistant & (kind == "tool_result"), "RESULT")
    )
    shown = F.when(what == "ASSISTANT", T.ws_clip(F.coalesce(get("$.text"), F.lit("")), TEXT_CHARS)).when(what == "TOOL", tool_line(name, get("$.input")))
    parts = each.select("session", "line_no", "pos", F.col("timestamp").alias("ts"), what.alias("kind"), shown.alias("text"), F.when(what == "TOOL", name).alias("tool")).where("kind IS NOT NULL AND (kind <> 'ASSISTANT' OR text <> '')")
    return prompts.unionByName(parts)


def counts(found: DataFrame) -> DataFrame:
    """The five counters of each session with any block."""
    of = lambda k, name: F.count_if(F.col("kind") == k).alias(name)
    return found.groupBy("session").agg(of("USER", "user_prompts"), of("ASSISTANT", "assistant_texts"), of("TOOL", "tool_calls"), of("THINKING", "thinking"), of("RESULT", "tool_results"))


def tool_histogram(found: DataFrame) -> DataFrame:
    """session, tool, n, nth: by count, then by first use."""
    first = F.min(F.struct("line_no", "pos")).alias("_first")
    by = found.where("kind = 'TOOL'").groupBy("session", "tool").agg(F.count("*").alias("n"), first)
    return by.withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("n"), "_first"))).drop("_first")


def sessions(lines: DataFrame) -> DataFrame:
    """session, first_ts, last_ts in the order of the file, and metadata: of each key the last value up to the first record
    of a user or assistant that names a folder."""
    r = records(lines)
    ts = F.nullif("timestamp", F.lit(""))
    spoken = F.col("type").isin("user", "assistant")
    cut = F.min(F.when(spoken & (F.col("cwd") != ""), F.col("line_no")))
    marked = r.withColumn("_cut", cut.over(Window.partitionBy("session")))
    keys = ("sessionId", "cwd", "gitBranch", "version")

    def last(k: str) -> Column:
        fine = spoken & (F.coalesce(F.col(k), F.lit("")) != "") & (F.col("line_no") <= F.coalesce("_cut", F.lit(2**62)))
        return F.max_by(F.when(fine, F.col(k)), F.when(fine, F.col("line_no"))).alias(k)

    return marked.groupBy("session").agg(F.min_by(ts, F.when(ts.isNotNull(), F.col("line_no"))).alias("first_ts"), F.max_by(ts, F.when(ts.isNotNull(), F.col("line_no"))).alias("last_ts"), *map(last, keys))


def digest(lines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """session, digest of sessions with enough prompts: a head of metadata and counts, then one line an event."""
    found = blocks(lines)
    # Labels of the digest.
    label = F.create_map(*[F.lit(x) for x in ("USER", "🧑 ЮЗЕР", "ASSISTANT", "🤖", "TOOL", "  ↳", "RESULT", "  =")])
    spoken = F.struct("line_no", "pos", F.concat(label[F.col("kind")], F.lit(": "), "text").alias("line"))
    told = found.where("kind IN ('USER', 'ASSISTANT', 'TOOL')").groupBy("session").agg(F.transform(F.array_sort(F.collect_list(spoken)), lambda x: x["line"]).alias("events"))
    tools = tool_histogram(found).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat("tool", F.lit("×"), F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ", ").alias("tools"))
    wide = sessions(lines).join(counts(found).where(F.col("user_prompts") >= s.least_prompts), "session").join(told, "session", "left").join(tools, "session", "left")
    n = lambda c: F.col(c).cast("string")
    head = F.array(
        F.lit("# ДАЙДЖЕСТ СЕССИИ (прототип жнеца)"), F.lit(""),
        F.concat(F.lit("- session: `"), F.coalesce("sessionId", F.lit("?")), F.lit("`")),
        F.concat(F.lit("- cwd: `"), F.coalesce("cwd", F.lit("?")), F.lit("`  |  branch: `"), F.coalesce("gitBranch", F.lit("-")), F.lit("`")),
        F.concat(F.lit("- период: "), F.coalesce("first_ts", F.lit("None")), F.lit(" → "), F.coalesce("last_ts", F.lit("None")), F.lit("  (~"), T.fmt_duration(F.col("first_ts"), F.col("last_ts")), F.lit(")")),
        F.concat(F.lit("- объём: промптов="), n("user_prompts"), F.lit(", реплик="), n("assistant_texts"), F.lit(", tool-вызовов="), n("tool_calls"), F.lit(", thinking-блоков выкинуто="), n("thinking"), F.lit(", tool-результатов выкинуто="), n("tool_results")),
        F.concat(F.lit("- инструменты: "), F.coalesce("tools", F.lit(""))), F.lit(""), F.lit("## Хронология (сжатая)"), F.lit(""),
    )
    return wide.select("session", F.array_join(F.concat(head, F.coalesce("events", F.array().cast("array<string>"))), "\n").alias("digest"))


def compression(digests: DataFrame, lines: DataFrame) -> DataFrame:
    """session, percent: the digest's bytes to the transcript's."""
    raw = lines.groupBy("session").agg(F.sum(F.octet_length("line") + 1).alias("raw"))
    return digests.join(raw, "session").select("session", F.floor(100 * F.octet_length("digest") / F.greatest("raw", F.lit(1))).alias("percent"))


def extractive_summary(digests: DataFrame, most: int = 400) -> DataFrame:
    """Default summariser (a stand-in for a model that callers may inject): the first prompt and the last line."""
    lines = F.split("digest", "\n", -1)
    prompts = F.filter(lines, lambda x: x.startswith("🧑"))
    return digests.select("session", F.lit("misc").alias("project"), F.coalesce(F.substring(F.get(prompts, F.lit(0)), 1, most), F.lit("")).alias("current_state"), F.coalesce(F.substring(F.element_at(lines, -1), 1, most), F.lit("")).alias("session_summary"))
