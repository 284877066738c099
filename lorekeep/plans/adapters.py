"""Views of the driver's tables in the engine's shapes, and the same views as DuckDB SQL.

``documents`` become notes, ``embeddings`` chunk vectors, ``conversations`` transcripts, ``events`` hook payloads,
test runs and proposals, so that every operator runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = "2024-03-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.to_timestamp(F.lit(NOW))


def notes(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """file, raw, mtime, is_top; ``edited``: an earlier version, in which every fifth note read otherwise."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    file = F.concat(F.when(i % 10 == 0, F.lit("sessions/")).otherwise(""), F.lit("doc_"), i.cast("string"), F.lit(".md"))
    front = F.when(i % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("---\nname: doc-"), i.cast("string"), F.lit("\n---\n")))
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    # every third note has a second section
    body = F.when(i % 3 == 0, F.concat(body, F.lit("\n## more\n"), F.substring("text", 1, 200))).otherwise(body)
    raw = F.concat(front, F.lit("# doc "), i.cast("string"), F.lit("\n"), body)
    if edited:
        raw = F.when(i % 5 == 0, F.concat(raw, F.lit("\nedited"))).otherwise(raw)
    mtime = F.timestamp_micros(F.unix_micros(now()) - (i % 90) * F.lit(86_400_000_000))
    return d.select(file.alias("file"), raw.alias("raw"), mtime.alias("mtime"), (i % 10 != 0).alias("is_top"))


NOTES = r"""
notes AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'sessions/' ELSE '' END || 'doc_' || doc_id || '.md' AS file,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE '---' || chr(10) || 'name: doc-' || doc_id || chr(10) || '---' || chr(10) END
  || '# doc ' || doc_id || chr(10) || replace(text, chr(10), chr(10) || chr(10))
  || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '## more' || chr(10) || substr(text, 1, 200) ELSE '' END AS raw,
  TIMESTAMP '2024-03-01' - to_days((doc_id % 90)::INT) AS mtime, doc_id, doc_id % 10 <> 0 AS is_top FROM documents)
"""

#: Lines, sections by a running sum over headings, greedy packing as a list fold, ordinals: independent of the engine's way.
CHUNKS = NOTES + r""",
body AS (SELECT file, regexp_replace(raw, '(?s)\A---\n.*?\n---\n', '') AS b FROM notes),
line AS (SELECT file, unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) AS pos FROM body),
sec AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS s FROM line),
grp AS (SELECT file, s, coalesce(max(CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1)) END), '') AS heading,
  regexp_replace(coalesce(string_agg(CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN NULL ELSE line END, chr(10) ORDER BY pos), ''), '^\s+|\s+$', '', 'g') AS t
  FROM sec GROUP BY file, s),
glued AS (SELECT file, s, heading, CASE WHEN heading <> '' THEN regexp_replace(heading || chr(10) || t, '\s+$', '') ELSE t END AS t FROM grp),
piece AS (SELECT file, s, heading, CASE WHEN t = '' THEN [] WHEN length(t) <= 1500 THEN [t] ELSE (
    SELECT list_append(r.o, r.b) FROM (SELECT list_reduce(
      list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''),
      lambda a, p: CASE WHEN a.b <> '' AND length(a.b) + length(p) + 2 > 1500 THEN {'o': list_append(a.o, a.b), 'b': p}
        ELSE {'o': a.o, 'b': CASE WHEN a.b = '' THEN p ELSE a.b || chr(10) || chr(10) || p END} END,
      {'o': []::VARCHAR[], 'b': ''}) AS r)) END AS ps FROM glued),
flat AS (SELECT file, s, heading, unnest(ps) AS text, generate_subscripts(ps, 1) AS n FROM piece),
chunks AS (SELECT file, heading, text, (row_number() OVER (PARTITION BY file ORDER BY s, n) - 1)::INT AS ord FROM flat)
"""

#: Hashed token counts in long form, normalised: rows, then the long form.
EMBED = r"""
tok AS (SELECT file, ord, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM chunks),
cell AS (SELECT file, ord, ('0x' || substr(md5(t), 31, 2))::INT % 64 AS i, count(*)::DOUBLE AS x FROM tok GROUP BY ALL),
unit AS (SELECT file, ord, i, x / sqrt(sum(x * x) OVER (PARTITION BY file, ord)) AS x FROM cell),
n_chunks AS (SELECT file, count(*) AS n FROM chunks GROUP BY file),
mean AS (SELECT file, i, sum(x) / any_value(n) AS x FROM unit JOIN n_chunks USING (file) GROUP BY file, i),
fvec0 AS (SELECT file, i, x / sqrt(sum(x * x) OVER (PARTITION BY file)) AS x FROM mean)
"""

#: Dense, centred over the top-level files, as lists.
CENTERED = r"""
top AS (SELECT DISTINCT file FROM fvec0 WHERE NOT contains(file, '/')),
dense AS (SELECT top.file, r.i, coalesce(x, 0) AS x FROM top CROSS JOIN range(64) r(i) LEFT JOIN fvec0 f ON f.file = top.file AND f.i = r.i),
cent AS (SELECT file, i, x - avg(x) OVER (PARTITION BY i) AS x FROM dense),
cnorm AS (SELECT file, i, x / sqrt(sum(x * x) OVER (PARTITION BY file)) AS x FROM cent),
fvec AS (SELECT file, list(x ORDER BY i) AS v FROM cnorm GROUP BY file)
"""


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file (the label), ord (the id), heading, text, vec."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("file"), F.col("vec_id").alias("ord"), F.lit("").alias("heading"), F.lit("").alias("text"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, line_no, line: conversations as JSON lines; assistants speak in blocks, with a tool call every second turn,
    and other roles are records that hold no events."""
    c = table(spark, sf_dir, "conversations").withColumn("_turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") - 1)
    ts = F.date_format(F.timestamp_micros(F.unix_micros(now()) + F.col("_turn") * 60_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.coalesce(F.col("text"), F.lit(""))
    tool = F.element_at(F.array(*map(F.lit, ("Bash", "Read", "TodoWrite", "Other"))), (F.col("_turn") % 4 + 1).cast("int"))
    key = F.element_at(F.array(*map(F.lit, ("command", "file_path", "todos", "first"))), (F.col("_turn") % 4 + 1).cast("int"))
    quote = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)
    blocks = F.concat(
        F.lit('[{"type":"thinking","text":"t"},{"type":"text","text":'), quote(text), F.lit("}"),
        F.when(F.col("_turn") % 2 == 1, F.concat(F.lit(',{"type":"tool_use","name":"'), tool, F.lit('","input":{"'), key, F.lit('":'), quote(F.substring(text, 1, 200)), F.lit(',"a":1}}'))).otherwise(""),
        F.lit("]"),
    )
    content = F.when(F.col("role") == "assistant", blocks).otherwise(quote(text))
    line = F.concat(F.lit('{"type":'), quote(F.col("role")), F.lit(',"timestamp":"'), ts, F.lit('","sessionId":"s'), F.col("conv_id").cast("string"), F.lit('","cwd":"'), F.when(F.col("_turn") >= 1, F.concat(F.lit("/w/p"), (F.col("conv_id") % 7).cast("string"))).otherwise(""), F.lit('","message":{"content":'), content, F.lit("}}"))
    return c.select(F.col("conv_id").cast("string").alias("session"), F.col("_turn").alias("line_no"), line.alias("line"))


TRANSCRIPT = r"""
conv AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn FROM conversations)
"""


def hook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hook payloads: seq, ts, event, cwd, tool_name, tool, session_id, input, output."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), "ts",
        F.when(F.col("event_id") % 2 == 0, "pre").otherwise("post").alias("event"),
        F.concat(F.lit("/w/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("cwd"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("tool_name"),
        F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.lit("alt")).alias("tool"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("props").alias("input"), F.col("props").alias("output"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size, mtime, raw: transcripts by size and time; some carry the sentinel."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    raw = F.when(i % 13 == 0, F.lit("x HARVEST_INTERNAL_v1 y")).otherwise("plain")
    mtime = F.timestamp_micros(F.unix_micros(now()) - (i % 50) * F.lit(60_000_000))
    return d.select(F.concat("source", F.lit("/"), i.cast("string")).alias("path"), (F.col("n_chars") * 10).alias("size"), mtime.alias("mtime"), raw.alias("raw"), i.alias("doc_id"))


def sweep_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier sweep saw: every second file, smaller by up to 4,000 bytes."""
    files = listing(spark, sf_dir).where("doc_id % 2 = 0")
    return files.select("path", (F.col("size") - (F.col("doc_id") % 5) * 1000).alias("size"), F.lit("ok").alias("res"))


LISTING = r"""
files AS (SELECT source || '/' || doc_id AS path, n_chars * 10 AS size, TIMESTAMP '2024-03-01' - to_minutes((doc_id % 50)::INT) AS mtime,
  doc_id, doc_id % 13 = 0 AS sentinel FROM documents),
state AS (SELECT path, size - (doc_id % 5) * 1000 AS size FROM files WHERE doc_id % 2 = 0),
eligible AS (SELECT f.* FROM files f LEFT JOIN state s USING (path)
  WHERE date_diff('second', mtime, TIMESTAMP '2024-03-01') >= 900 AND (s.size IS NULL OR f.size - s.size >= 2000))
"""


def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, cwd, cmd, output of test commands."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    out = (
        F.when(i % 6 == 0, F.concat(s(i % 40 + 5), F.lit(" tests completed, "), s(i % 5), F.lit(" failed"), F.when(i % 12 == 0, F.lit(", 2 skipped")).otherwise("")))
        .when(i % 6 == 1, F.concat(s(i % 4), F.lit(" failed, "), s(i % 30), F.lit(" passed")))
        .when(i % 6 == 2, F.concat(s(i % 30), F.lit(" passed, "), s(i % 4), F.lit(" failed")))
        .when(i % 6 == 3, F.lit("BUILD SUCCESSFUL"))
        .when(i % 6 == 4, F.lit("BUILD FAILED Compilation error"))
        .otherwise("nothing")
    )
    cmd = F.when(i % 6 >= 3, "./gradlew  test").otherwise("python -m  pytest -q")
    return e.select(i.alias("seq"), "ts", F.concat(F.lit("/w/repo"), s(F.col("user_id") % 50)).alias("cwd"), cmd.alias("cmd"), out.alias("output"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, id, title, trigger, confidence, domain, action, evidence: as a distiller would propose; ids repeat."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    full = i % 3 != 0
    return e.select(
        i.alias("seq"), F.concat(F.lit("Habit "), (F.col("user_id") % 97).cast("string"), F.lit(" "), "event_type").alias("id"), F.lit(None).cast("string").alias("title"),
        F.when(full, F.concat(F.lit("when "), "event_type")).otherwise("").alias("trigger"),
        F.when(i % 11 == 0, F.lit("bad")).otherwise(((i % 12) / F.lit(10.0)).cast("string")).alias("confidence"),
        F.col("event_type").alias("domain"), F.when(full, F.lit("do it")).otherwise("").alias("action"), F.lit("seen").alias("evidence"),
    )
