"""Registered queries over the driver's tables, each with the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.config import DEFAULTS
from lorekeep.functions import text as T
from lorekeep.functions import vectors as V
from lorekeep.operators import journal as J
from lorekeep.operators import notes as N
from lorekeep.operators import observations as O
from lorekeep.operators import transcripts as R
from lorekeep.plans import adapters as A
from lorekeep.plans import maintain as M
from lorekeep.sources import files, state
from lorekeep.sources import notes as S
from lorekeep.streaming import hooks as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts)


# ---- vectors, recall ------------------------------------------------------------------------------------------------

_RECALL = """
q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qvec FROM embeddings WHERE vec_id < 4),
s AS (SELECT query, label::VARCHAR AS file, vec_id AS ord, list_dot_product(qvec, embedding::DOUBLE[]) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file, ord) AS rank FROM s)
"""


def _recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.chunk_vectors(spark, sf_dir)
    queries = found.where("ord < 4").select(F.col("ord").alias("query"), F.col("vec").alias("qvec"))
    return N.recall(found, queries)


@query("o1_recall_topk", _with(_RECALL) + " SELECT query, file, ord, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 8")
def recall_topk(spark, sf_dir):
    return _recalled(spark, sf_dir).select("query", "file", "ord", "rank", F.round("score", 6).alias("score"))


@query("j8_query_cross", _with(_RECALL) + " SELECT query, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM s GROUP BY query")
def query_cross(spark, sf_dir):
    found = A.chunk_vectors(spark, sf_dir)
    queries = found.where("ord < 4").select(F.col("ord").alias("query"), F.col("vec").alias("qvec"))
    scored = found.join(F.broadcast(queries), F.lit(True)).withColumn("score", V.dot(F.col("qvec"), F.col("vec")))
    return scored.groupBy("query").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 4).alias("total"))


@query("f25_l2_normalize", "SELECT vec_id, round(e[1] * 3 / (3 * sqrt(list_dot_product(e, e))), 6) AS first, round(e[64] / sqrt(list_dot_product(e, e)), 6) AS last FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def l2(spark, sf_dir):
    v = V.l2_normalize(F.transform("vec", lambda x: x * 3))
    return A.chunk_vectors(spark, sf_dir).select(F.col("ord").alias("vec_id"), v.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


@query("f26_dot", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot(spark, sf_dir):
    a = A.chunk_vectors(spark, sf_dir)
    return a.select((F.col("ord") + 1).alias("ord"), F.col("vec").alias("w")).join(a, "ord").select((F.col("ord") - 1).alias("vec_id"), F.round(V.dot(F.col("w"), F.col("vec")), 6).alias("dot"))


@query("p20_recall_projection", _with(A.CHUNKS, "s AS (SELECT *, ((length(text) * 7) % 1000) / 1000.0 AS score FROM chunks)") + """
 SELECT file, ord, '[' || printf('%.3f', score::DOUBLE) || '] ' || file || CASE WHEN heading <> '' THEN ' › ' || heading ELSE '' END || chr(10)
 || CASE WHEN length(text) > 600 THEN regexp_replace(substr(text, 1, 600), '\\s+$', '') || ' …' ELSE text END AS hit FROM s""".replace("\\\\", "\\"))
def hits(spark, sf_dir):
    score = ((F.length("text") * 7) % 1000) / F.lit(1000.0)
    return N.chunks(A.notes(spark, sf_dir)).select("file", "ord", N.format_hit(score, F.col("file"), F.col("heading"), F.col("text")).alias("hit"))


@query("a1_file_mean_vec", """WITH l AS (SELECT label::VARCHAR AS file, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
 m AS (SELECT file, i, avg(x) AS x FROM l GROUP BY ALL), u AS (SELECT file, i, x / sqrt(sum(x * x) OVER (PARTITION BY file)) AS x FROM m)
 SELECT file, round(max(CASE WHEN i = 1 THEN x END), 6) AS first, round(max(CASE WHEN i = 64 THEN x END), 6) AS last, round(sum(x), 6) AS total FROM u GROUP BY file""")
def file_mean(spark, sf_dir):
    v = N.file_vectors(A.chunk_vectors(spark, sf_dir), 64)
    return v.select("file", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(63)), 6).alias("last"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_EMB_CENTERED = """
l AS (SELECT label::VARCHAR AS file, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT file, i, avg(x) AS x FROM l GROUP BY ALL), u AS (SELECT file, i, x / sqrt(sum(x * x) OVER (PARTITION BY file)) AS x FROM m),
c AS (SELECT file, i, x - avg(x) OVER (PARTITION BY i) AS x FROM u), n AS (SELECT file, i, x / sqrt(sum(x * x) OVER (PARTITION BY file)) AS x FROM c)
"""


@query("a2_center_vectors", _with(_EMB_CENTERED) + " SELECT file, round(max(CASE WHEN i = 1 THEN x END), 6) AS first, round(max(CASE WHEN i = 64 THEN x END), 6) AS last FROM n GROUP BY file")
def centered(spark, sf_dir):
    v = N.file_vectors(A.chunk_vectors(spark, sf_dir), 64, centered=True)
    return v.select("file", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(63)), 6).alias("last"))


def _note_vectors(spark: SparkSession, sf_dir: str, only_top: bool = True) -> DataFrame:
    found = N.chunks(A.notes(spark, sf_dir))
    embedded = V.hash_embed(found, ["file", "ord"], "text")
    return N.file_vectors(embedded, V.HASH_DIM, only_top_level=only_top, centered=True)


_NOTE_VECTORS = _with(A.CHUNKS, A.EMBED, A.CENTERED)
_PAIRS = _NOTE_VECTORS + ", pair AS (SELECT a.file AS a, b.file AS b, list_dot_product(a.v, b.v) AS score FROM fvec a JOIN fvec b ON a.file < b.file)"


@query("j2_dup_self_join", _PAIRS + " SELECT a, b, round(score, 3) AS score FROM pair WHERE round(score, 9) >= 0.55")
def dup_join(spark, sf_dir):
    return N.dup_pairs(_note_vectors(spark, sf_dir))


@query("o5_dup_order", _PAIRS + ", d AS (SELECT a, b, round(score, 3) AS score FROM pair WHERE round(score, 9) >= 0.55) SELECT a, b, score, row_number() OVER (ORDER BY score DESC, a, b) AS pos FROM d")
def dup_order(spark, sf_dir):
    return N.dup_positions(_note_vectors(spark, sf_dir))


_BEST = _PAIRS + """, two_way AS (SELECT a AS f, b AS t, score FROM pair UNION ALL SELECT b, a, score FROM pair),
 best AS (SELECT f AS file, t AS target, score, row_number() OVER (PARTITION BY f ORDER BY round(score, 12) DESC, t) AS rank FROM two_way WHERE round(score, 9) >= 0.25 QUALIFY rank <= 3),
 slug AS (SELECT file, 'doc-' || doc_id AS slug FROM notes)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.links(_note_vectors(spark, sf_dir), N.slugs(A.notes(spark, sf_dir)))


@query("w1_links_topn", _BEST + " SELECT best.file, rank::INT AS rank, target, slug, round(score, 6) AS score FROM best JOIN slug ON slug.file = target")
def links_topn(spark, sf_dir):
    return _links(spark, sf_dir).withColumn("score", F.round("score", 6)).select("file", "rank", "target", "slug", "score")


@query("j4_link_slug_join", _BEST + " SELECT slug, count(*) AS n FROM best JOIN slug ON slug.file = target GROUP BY slug")
def link_slugs(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("slug").agg(F.count("*").alias("n"))


@query("s12_sink_links", _BEST + """, blk AS (SELECT b.file, string_agg('- [[' || slug || ']] — ' || printf('%.2f', round(score, 6)), chr(10) ORDER BY rank) AS lines FROM best b JOIN slug ON slug.file = target GROUP BY b.file)
 SELECT n.file, md5(regexp_replace(raw, '\\s+$', '') || chr(10) || chr(10) || '<!-- auto-related:start -->' || chr(10) || '## Связанные (авто)' || chr(10) || lines || chr(10) || '<!-- auto-related:end -->' || chr(10)) AS new_md5, true AS changed
 FROM notes n JOIN blk USING (file)""".replace("\\\\", "\\"))
def sink_links(spark, sf_dir):
    found = _links(spark, sf_dir).withColumn("score", F.round("score", 6))
    return N.apply_links(A.notes(spark, sf_dir).drop("mtime", "is_top"), found).select("file", F.md5(F.col("new_raw").cast("binary")).alias("new_md5"), "changed")


@query("x1_injected_embedder", _with(A.CHUNKS, A.EMBED) + " SELECT file, ord, i::INT AS i, round(x, 6) AS x FROM unit")
def injected_embedder(spark, sf_dir):
    v = V.injected(hashed_counts)(N.chunks(A.notes(spark, sf_dir)), ["file", "ord"], "text")
    return v.select("file", "ord", F.posexplode("vec").alias("i", "x")).where("x > 0").select("file", "ord", "i", F.round("x", 6).alias("x"))


def hashed_counts(texts: list[str]):
    """An embedder as a caller would bring it: texts to a matrix. Counts of hashed words."""
    import hashlib

    import numpy as np
    import regex

    out, cells = np.zeros((len(texts), V.HASH_DIM)), {}
    for k, t in enumerate(texts):
        for w in regex.findall(r"[\p{L}\p{N}_]+", t.lower()):
            if w not in cells:
                cells[w] = hashlib.md5(w.encode()).digest()[-1] % V.HASH_DIM
            out[k, cells[w]] += 1
    return out


_NO_INDEX = _PAIRS + """, two_way AS (SELECT a AS f, b AS t, score FROM pair UNION ALL SELECT b, a, score FROM pair),
 best AS (SELECT f AS file, t AS target, score, row_number() OVER (PARTITION BY f ORDER BY round(score, 12) DESC, t) AS rank FROM two_way
  WHERE round(score, 9) >= 0.25 AND f <> 'doc_1.md' AND t <> 'doc_1.md' QUALIFY rank <= 3)"""


@query("p19_link_exclude", _NO_INDEX + " SELECT file, rank::INT AS rank, target, round(score, 6) AS score FROM best")
def link_exclude(spark, sf_dir):
    """The index file is neither source nor target of links, though it counts in the centring."""
    name = F.when(F.col("file") == "doc_1.md", DEFAULTS.index_file).otherwise(F.col("file"))
    found = N.links(_note_vectors(spark, sf_dir).withColumn("file", name), N.slugs(A.notes(spark, sf_dir).withColumn("file", name)))
    return found.select("file", "rank", "target", F.round("score", 6).alias("score"))


@query("x2_hash_embed", _with(A.CHUNKS, A.EMBED) + " SELECT file, ord, i::INT AS i, round(x, 6) AS x FROM unit")
def hash_embedding(spark, sf_dir):
    v = V.hash_embed(N.chunks(A.notes(spark, sf_dir)), ["file", "ord"], "text")
    return v.select("file", "ord", F.posexplode("vec").alias("i", "x")).where("x > 0").select("file", "ord", "i", F.round("x", 6).alias("x"))


# ---- notes ----------------------------------------------------------------------------------------------------------


@query("s1_scan_notes", _with(A.NOTES) + " SELECT file, length(raw) AS n, is_top FROM notes")
def scan_notes(spark, sf_dir):
    return A.notes(spark, sf_dir).select("file", F.length("raw").cast("long").alias("n"), "is_top")


@query("u2_corpus_union", _with(A.NOTES) + " SELECT is_top, count(*) AS n FROM notes GROUP BY is_top")
def corpus_union(spark, sf_dir):
    n = A.notes(spark, sf_dir)
    return n.where("is_top").unionByName(n.where("NOT is_top")).groupBy("is_top").agg(F.count("*").alias("n"))


@query("p2_top_level_filter", _with(A.NOTES) + " SELECT file FROM notes WHERE NOT contains(file, '/')")
def top_level(spark, sf_dir):
    return A.notes(spark, sf_dir).where(~F.col("file").contains("/")).select("file")


@query("p3_nonempty_vec_filter", _with(A.CHUNKS, A.EMBED) + " SELECT DISTINCT file FROM fvec0")
def nonempty(spark, sf_dir):
    return N.file_vectors(V.hash_embed(N.chunks(A.notes(spark, sf_dir)), ["file", "ord"], "text"), V.HASH_DIM).select("file")


@query("f1_content_hash", _with(A.NOTES) + " SELECT file, substr(sha256(raw), 1, 16) AS hash FROM notes")
def hashes(spark, sf_dir):
    return A.notes(spark, sf_dir).select("file", T.content_hash(F.col("raw")).alias("hash"))


@query("f2_strip_frontmatter", _with(A.NOTES) + " SELECT file, md5(CASE WHEN doc_id % 7 = 0 THEN raw ELSE substr(raw, strpos(raw, chr(10) || '---' || chr(10)) + 5) END) AS body FROM notes")
def frontmatter(spark, sf_dir):
    return A.notes(spark, sf_dir).select("file", F.md5(T.strip_frontmatter(F.col("raw")).cast("binary")).alias("body"))


@query("f3_slug_of", _with(A.NOTES) + " SELECT file, 'doc-' || doc_id AS slug FROM notes")
def slug_of(spark, sf_dir):
    return N.slugs(A.notes(spark, sf_dir))


@query("f24_stem_kebab", "SELECT DISTINCT source || '_x' AS name, source || '-x' AS slug FROM documents")
def stems(spark, sf_dir):
    name = F.concat("source", F.lit("_x"))
    return A.table(spark, sf_dir, "documents").select(name.alias("name"), T.stem_kebab(F.concat(F.lit("a/"), name, F.lit(".md"))).alias("slug")).distinct()


_MARKED = r"""m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || '<!-- auto-related:start -->x<!-- auto-related:end -->' || chr(10) || ' tail '
 WHEN 2 THEN text || '<!-- auto-related:start --> open' ELSE 'a <!-- auto-related:end --> b <!-- auto-related:start --> c' END AS raw FROM documents)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("doc_id") % 4, F.col("text")
    s, e = DEFAULTS.related_start, DEFAULTS.related_end
    raw = F.when(i == 0, t).when(i == 1, F.concat(t, F.lit(f"\n{s}x{e}\n tail "))).when(i == 2, F.concat(t, F.lit(f"{s} open"))).otherwise(F.lit(f"a {e} b {s} c"))
    return A.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query("f4_strip_related", _with(_MARKED) + r""" SELECT doc_id, md5(CASE doc_id % 4 WHEN 1 THEN regexp_replace(string_split(raw, chr(10) || '<!-- auto')[1], '^\s+|\s+$', '', 'g') || chr(10) || 'tail' || chr(10)
 WHEN 3 THEN 'a <!-- auto-related:end --> b' || chr(10) ELSE raw END) AS body FROM m""")
def strip_related(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", F.md5(T.strip_related(F.col("raw")).cast("binary")).alias("body"))


@query("f5_remove_block", _with(_MARKED) + r""" SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN regexp_replace(raw, '\s+$', '') || chr(10)
 WHEN 1 THEN regexp_replace(string_split(raw, chr(10) || '<!-- auto')[1], '\s+$', '') || chr(10) || chr(10) || 'tail' || chr(10)
 WHEN 2 THEN regexp_replace(string_split(raw, '<!-- auto')[1], '\s+$', '') || chr(10)
 ELSE 'a <!-- auto-related:end --> b' || chr(10) || chr(10) || 'b <!-- auto-related:start --> c' || chr(10) END) AS body FROM m""")
def remove_block(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", F.md5(T.remove_block(F.col("raw")).cast("binary")).alias("body"))


@query("f6_render_block", "SELECT vec_id, '<!-- auto-related:start -->' || chr(10) || '## Связанные (авто)' || chr(10) || '- [[v' || vec_id || ']] — ' || printf('%.2f', (vec_id % 100) / 100.0::DOUBLE) || chr(10) || '<!-- auto-related:end -->' AS block FROM embeddings")
def render_block(spark, sf_dir):
    link = F.array(F.struct(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("slug"), ((F.col("vec_id") % 100) / F.lit(100.0)).alias("score")))
    return A.table(spark, sf_dir, "embeddings").select("vec_id", T.render_block(link).alias("block"))


_LINES = _with(A.NOTES) + r""", line AS (SELECT file, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) - 1 AS pos FROM notes)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.notes(spark, sf_dir).select("file", F.posexplode(T.split_lines(F.col("raw"))).alias("pos", "line"))


@query("f7_heading_parse", _LINES + r" SELECT file, pos::INT AS pos, trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1)) AS heading FROM line WHERE regexp_matches(line, '^#{1,6}\s')")
def headings(spark, sf_dir):
    return _lines(spark, sf_dir).where(T.is_heading(F.col("line"))).select("file", "pos", T.heading_text(F.col("line")).alias("heading"))


@query("f8_split_lines", _LINES + " SELECT file, count(*) AS n, sum(length(line))::BIGINT AS chars FROM line GROUP BY file")
def line_split(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n"), F.sum(F.length("line")).cast("long").alias("chars"))


@query("w4_section_running_sum", _LINES + r" SELECT file, pos::INT AS pos, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos)::BIGINT AS section FROM line")
def sections(spark, sf_dir):
    run = F.sum(T.is_heading(F.col("line")).cast("int")).over(Window.partitionBy("file").orderBy("pos"))
    return _lines(spark, sf_dir).select("file", "pos", run.alias("section"))


_CHUNK_ROWS = _with(A.CHUNKS) + " SELECT file, heading, md5(text) AS text, ord FROM chunks"


@query("f10_chunk_text", _CHUNK_ROWS)
def chunk_text(spark, sf_dir):
    return N.chunks(A.notes(spark, sf_dir)).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("f9_split_pack", _with(A.CHUNKS) + " SELECT file, count(*) AS n, max(length(text))::BIGINT AS longest FROM chunks GROUP BY file")
def split_pack(spark, sf_dir):
    return N.chunks(A.notes(spark, sf_dir)).groupBy("file").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


@query("w5_chunk_ord", _with(A.CHUNKS) + " SELECT file, min(ord) AS lo, max(ord) AS hi, count(DISTINCT ord) AS n FROM chunks GROUP BY file")
def chunk_ord(spark, sf_dir):
    return N.chunks(A.notes(spark, sf_dir)).groupBy("file").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count_distinct("ord").alias("n"))


def _index(spark: SparkSession, sf_dir: str):
    before = A.notes(spark, sf_dir, edited=True)
    old_files, old_chunks = N.file_table(before, "hash64"), N.chunks(before)
    old = V.hash_embed(old_chunks, ["file", "heading", "text", "ord"], "text")
    return N.build_index(A.notes(spark, sf_dir), old_files, old, "hash64")


_REUSE = _with(A.CHUNKS) + ", reuse AS (SELECT c.*, doc_id % 5 <> 0 AS reused FROM chunks c JOIN notes USING (file))"


@query("j1_incremental_reuse", _REUSE + " SELECT file, ord, reused FROM reuse")
def incremental(spark, sf_dir):
    return _index(spark, sf_dir)[1].select("file", "ord", "reused")


@query("u3_index_union", _REUSE + " SELECT reused, count(*) AS n, sum(length(text))::BIGINT AS chars FROM reuse GROUP BY reused")
def index_union(spark, sf_dir):
    return _index(spark, sf_dir)[1].groupBy("reused").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("a7_index_stats", _REUSE + " SELECT (SELECT count(*) FROM notes) AS files, count(*) AS chunks, count(*) FILTER (reused) AS reused, count(*) FILTER (NOT reused) AS embedded FROM reuse")
def index_stats(spark, sf_dir):
    return N.index_stats(*_index(spark, sf_dir))


_STALE = _with(A.NOTES) + ", stale AS (SELECT file, (doc_id % 90)::DOUBLE AS age_days FROM notes WHERE is_top AND doc_id % 90 >= 30)"


@query("p1_stale_filter", _STALE + " SELECT * FROM stale")
def stale(spark, sf_dir):
    return N.stale(A.notes(spark, sf_dir), A.now())


@query("o5_stale_order", _STALE + " SELECT *, row_number() OVER (ORDER BY age_days DESC, file) AS pos FROM stale")
def stale_order(spark, sf_dir):
    return N.positions(N.stale(A.notes(spark, sf_dir), A.now()), [F.desc("age_days"), F.col("file")], F.col("age_days"))


@query("f36_age_days", _with(A.NOTES) + " SELECT file, (doc_id % 90)::DOUBLE AS age FROM notes")
def ages(spark, sf_dir):
    return A.notes(spark, sf_dir).select("file", T.age_days(F.col("mtime"), A.now()).alias("age"))


@query("a8_report_counts", _PAIRS + ", d AS (SELECT a FROM pair WHERE round(score, 9) >= 0.55) SELECT (SELECT count(*) FROM notes WHERE is_top AND doc_id % 90 >= 30) AS stale, (SELECT count(*) FROM d) AS pairs")
def report_counts(spark, sf_dir):
    old = N.stale(A.notes(spark, sf_dir), A.now()).agg(F.count("*").alias("stale"))
    return old.join(F.broadcast(N.dup_count(_note_vectors(spark, sf_dir))), F.lit(True))


@query("s11_sink_review", _STALE + """, l AS (SELECT row_number() OVER (ORDER BY age_days DESC, file) + 1 AS pos, '- `' || file || '` — ' || age_days::VARCHAR || ' дн.' AS line FROM stale),
 h AS (SELECT 0 AS pos, '## Протухшие (> 30 дн. без правок) — ' || count(*) AS line FROM stale)
 SELECT 1 AS section, pos, line FROM l UNION ALL SELECT 1, pos, line FROM h UNION ALL SELECT 1, 1, '' UNION ALL SELECT 1, 4611686018427387904, ''""")
def sink_review(spark, sf_dir):
    none = spark.createDataFrame([], "a string, b string, score double")
    return N.review(N.stale(A.notes(spark, sf_dir), A.now()), none).where("section = 1")


@query("u1_known_projects", "SELECT DISTINCT source AS name FROM documents UNION SELECT DISTINCT replace(lang, '_', '-') || '-x' FROM documents WHERE lang IS NOT NULL")
def known_projects(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return N.known_projects(d.select(F.concat(F.lit("sessions/"), "source", F.lit(".md")).alias("file")), d.where("lang IS NOT NULL").select(F.concat(F.lit("project_"), "lang", F.lit("_x.md")).alias("file")))


QUERIES["a10_distinct_projects"], ORACLE["a10_distinct_projects"] = known_projects, ORACLE["u1_known_projects"]


# ---- scalar functions over whole columns ------------------------------------------------------------------------------


@query("f11_ws_clip", r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
 SELECT doc_id, CASE WHEN length(t) > 140 THEN substr(t, 1, 140) || '…' ELSE t END AS clip FROM t""")
def ws_clip(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.ws_clip(F.col("text"), 140).alias("clip"))


@query("f12_raw_clip", "SELECT doc_id, md5(substr(text, 1, 2000)) AS clip FROM documents")
def raw_clip(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring("text", 1, DEFAULTS.input_chars).cast("binary")).alias("clip"))


@query("f14_fmt_duration", """WITH m AS (SELECT event_id, (event_id * 37) % 300 AS m FROM events) SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '?'
 WHEN m >= 60 THEN (m // 60) || 'ч ' || (m % 60) || 'м' ELSE m || 'м' END AS dur FROM m""")
def durations(spark, sf_dir):
    i = F.col("event_id")
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = F.unix_micros(A.now())
    end = F.when(i % 50 == 0, F.lit("not a time")).otherwise(iso(base + (i * 37) % 300 * 60_000_000 + 59_000_000))
    return A.table(spark, sf_dir, "events").select("event_id", T.fmt_duration(iso(base), end).alias("dur"))


@query("f15_short_sid_day", "SELECT doc_id, substr(CASE WHEN doc_id % 2 = 0 THEN 'session' || doc_id ELSE source || '-file' END, 1, 8) AS sid, CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '2024-03-01' END AS day FROM documents")
def short_sid(spark, sf_dir):
    i = F.col("doc_id")
    sid = T.short_sid(F.when(i % 2 == 0, F.concat(F.lit("session"), i.cast("string"))).otherwise(""), F.concat("source", F.lit("-file")))
    return A.table(spark, sf_dir, "documents").select("doc_id", sid.alias("sid"), T.day(F.when(i % 3 == 0, "").otherwise("2024-03-01T10:00:00Z")).alias("day"))


@query("f16_slug_project", r"SELECT doc_id, coalesce(nullif(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[^a-z0-9-]', '-', 'g'), ''), 'misc') AS slug FROM documents")
def slug_project(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.slug_project(F.col("text")).alias("slug"))


@query("f17_slug_id", r"SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'instinct') AS slug FROM documents")
def slug_id(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.slug_id(F.col("text")).alias("slug"))


@query("f18_clamp", "SELECT event_id, greatest(0.3, least(0.9, value / 100)) AS v FROM events")
def clamped(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", T.clamp(F.col("value") / 100, 0.3, 0.9).alias("v"))


@query("f19_parse_confidence", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 10) / 10.0::DOUBLE END AS confidence FROM events")
def confidence(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 7 == 0, F.lit("confidence: ..")).otherwise(F.concat(F.lit("x: 1\nconfidence:  0."), (i % 10).cast("string"), F.lit("\n")))
    return A.table(spark, sf_dir, "events").select("event_id", T.parse_confidence(text).alias("confidence"))


@query("f20_bump_regex", "SELECT event_id, 'id: a' || chr(10) || 'confidence: 0.' || (event_id % 9 + 1) || '0' || chr(10) || 'last_observed: 2024-03-01' || chr(10) || 'confidence: 9' AS raw FROM events")
def bump(spark, sf_dir):
    conf = ((F.col("event_id") % 9 + 1) / F.lit(10.0)).cast("decimal(4,2)")
    return A.table(spark, sf_dir, "events").select("event_id", O.bump(F.lit("id: a\nconfidence: 0.1\nlast_observed: 2000-01-01\nconfidence: 9"), conf, F.to_date(A.now())).alias("raw"))


@query("f21_json_extract_greedy", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def json_greedy(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 == 0, F.lit("no { json }")).otherwise(F.concat(F.lit("Sure:\n"), "props", F.lit("\nDone")))
    return A.table(spark, sf_dir, "events").select("event_id", F.try_variant_get(T.json_greedy(text), "$.k", "string").alias("k"))


@query("f22_coalesce_fields", "SELECT event_id AS seq, CASE WHEN event_id % 5 <> 0 THEN event_type ELSE 'unknown' END AS tool, user_id::VARCHAR AS session FROM events")
def coalesced(spark, sf_dir):
    return O.observe(A.hook_events(spark, sf_dir)).select("seq", "tool", "session")


@query("f23_path_slug", "SELECT page_id, replace(url, '/', '-') AS slug FROM pages")
def path_slug(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", T.path_slug(F.col("url")).alias("slug"))


@query("f28_repo_name", "SELECT event_id, event_type AS repo FROM events")
def repo_name(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", O.repo_name(F.concat(F.lit("/w/"), "event_type", F.lit("//"))).alias("repo"))


@query("f29_cmd_short", r"SELECT doc_id, substr(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 80) AS cmd FROM documents")
def cmd_short(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.cmd_short(F.col("text")).alias("cmd"))


@query("f32_title_default", "SELECT DISTINCT event_type, upper(substr(replace(event_type || '-x', '-', ' '), 1, 1)) || lower(substr(replace(event_type || '-x', '-', ' '), 2)) AS title FROM events")
def titles(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_type", T.title_default(F.concat("event_type", F.lit("-x"))).alias("title")).distinct()


@query("f33_unescape_newlines", "SELECT doc_id, md5(text) AS text FROM documents")
def unescaped(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.unescape_newlines(F.replace("text", F.lit("\n"), F.lit("\\n"))).cast("binary")).alias("text"))


# ---- transcripts ----------------------------------------------------------------------------------------------------

_FLAT = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_EVENTS = _with(A.TRANSCRIPT, rf"""flat AS (SELECT *, {_FLAT} AS t, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped FROM conv),
ev AS (SELECT conv_id, turn, 0 AS pos, 'USER' AS kind, stripped AS text, NULL AS tool FROM flat WHERE role = 'user' AND stripped <> ''
  AND NOT regexp_matches(stripped, '^(<local-command|<command-|<bash-|Caveat:)')
  UNION ALL SELECT conv_id, turn, 0, 'THINKING', NULL, NULL FROM flat WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 1, 'ASSISTANT', CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || '…' ELSE t END, NULL FROM flat WHERE role = 'assistant' AND t <> ''
  UNION ALL SELECT conv_id, turn, 2, 'TOOL', NULL, ['Bash', 'Read', 'TodoWrite', 'Other'][turn % 4 + 1] FROM flat WHERE role = 'assistant' AND turn % 2 = 1)""")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(A.transcript_lines(spark, sf_dir))


@query("s4_scan_jsonl", "SELECT conv_id::VARCHAR AS session, count(*) AS n FROM conversations GROUP BY conv_id")
def scan_jsonl(spark, sf_dir):
    lines = A.transcript_lines(spark, sf_dir)
    noise = lines.select("session", "line_no", F.explode(F.array(F.lit(""), F.lit("{bad"), F.lit("[1]"))).alias("line"))
    return R.records(lines.unionByName(noise)).groupBy("session").agg(F.count("*").alias("n"))


@query("p6_record_dispatch", _EVENTS + " SELECT conv_id::VARCHAR AS session, turn AS line_no, pos::INT AS pos, kind FROM ev")
def dispatch(spark, sf_dir):
    return _blocks(spark, sf_dir).select("session", "line_no", "pos", "kind")


@query("p4_user_text_filter", _EVENTS + " SELECT conv_id::VARCHAR AS session, turn AS line_no, md5(text) AS text FROM ev WHERE kind = 'USER'")
def user_texts(spark, sf_dir):
    return _blocks(spark, sf_dir).where("kind = 'USER'").select("session", "line_no", F.md5(F.col("text").cast("binary")).alias("text"))


@query("p5_meta_record_filter", _EVENTS + " SELECT conv_id::VARCHAR AS session, count(*) AS n FROM ev WHERE kind = 'USER' AND turn % 3 <> 0 GROUP BY conv_id")
def meta_records(spark, sf_dir):
    lines = A.transcript_lines(spark, sf_dir).withColumn("line", F.when(F.col("line_no") % 3 == 0, F.concat(F.lit('{"isMeta":true,'), F.substr("line", F.lit(2)))).otherwise(F.col("line")))
    return R.blocks(lines).where("kind = 'USER'").groupBy("session").agg(F.count("*").alias("n"))


_COUNTS = _EVENTS + """, c AS (SELECT conv_id::VARCHAR AS session, count(*) FILTER (kind = 'USER') AS user_prompts, count(*) FILTER (kind = 'ASSISTANT') AS assistant_texts,
 count(*) FILTER (kind = 'TOOL') AS tool_calls, count(*) FILTER (kind = 'THINKING') AS thinking, 0::BIGINT AS tool_results FROM ev GROUP BY conv_id)"""


@query("a3_digest_counts", _COUNTS + " SELECT * FROM c")
def digest_counts(spark, sf_dir):
    return R.counts(_blocks(spark, sf_dir))


@query("p7_min_prompts_having", _COUNTS + " SELECT session FROM c WHERE user_prompts >= 2")
def min_prompts(spark, sf_dir):
    return R.counts(_blocks(spark, sf_dir)).where(F.col("user_prompts") >= DEFAULTS.least_prompts).select("session")


@query("a4_tool_histogram", _EVENTS + """, h AS (SELECT conv_id::VARCHAR AS session, tool, count(*) AS n, min(turn) AS f FROM ev WHERE kind = 'TOOL' GROUP BY conv_id, tool)
 SELECT session, tool, n, row_number() OVER (PARTITION BY session ORDER BY n DESC, f)::INT AS nth FROM h""")
def tool_histogram(spark, sf_dir):
    return R.tool_histogram(_blocks(spark, sf_dir))


_TURN_TS = "strftime(TIMESTAMP '2024-03-01' + to_minutes({}), '%Y-%m-%dT%H:%M:%SZ')"


@query("a5_first_last_ts", _with(A.TRANSCRIPT) + f" SELECT conv_id::VARCHAR AS session, {_TURN_TS.format('min(turn)')} AS first_ts, {_TURN_TS.format('max(turn)')} AS last_ts FROM conv GROUP BY conv_id")
def first_last(spark, sf_dir):
    return R.sessions(A.transcript_lines(spark, sf_dir)).select("session", "first_ts", "last_ts")


@query("a6_session_meta", _with(A.TRANSCRIPT) + """ SELECT conv_id::VARCHAR AS session, CASE WHEN count(*) FILTER (role IN ('user', 'assistant')) > 0 THEN 's' || conv_id END AS sid,
 CASE WHEN count(*) FILTER (role IN ('user', 'assistant') AND turn >= 1) > 0 THEN '/w/p' || (conv_id % 7) END AS cwd FROM conv GROUP BY conv_id""")
def session_meta(spark, sf_dir):
    return R.sessions(A.transcript_lines(spark, sf_dir)).select("session", F.col("sessionId").alias("sid"), "cwd")


@query("f13_tool_oneliner", _EVENTS + r""", c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(substr(text, 1, 200), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS a FROM conv WHERE role = 'assistant' AND turn % 2 = 1),
 k AS (SELECT conv_id, turn, ['Bash', 'Read', 'TodoWrite', 'Other'][turn % 4 + 1] AS tool, CASE WHEN turn % 4 = 3 THEN regexp_replace('first=' || a, '\s+$', '') ELSE a END AS a FROM c)
 SELECT conv_id::VARCHAR AS session, turn AS line_no, CASE WHEN tool = 'TodoWrite' OR a IN ('', '0') THEN tool ELSE tool || '(' || CASE WHEN length(a) > 140 THEN substr(a, 1, 140) || '…' ELSE a END || ')' END AS text FROM k""")
def tool_oneliner(spark, sf_dir):
    return _blocks(spark, sf_dir).where("kind = 'TOOL'").select("session", "line_no", "text")


_DIGEST = _COUNTS + r""", arg AS (SELECT conv_id, turn, regexp_replace(regexp_replace(substr(text, 1, 200), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS a FROM conv WHERE role = 'assistant' AND turn % 2 = 1),
 named AS (SELECT conv_id, turn, ['Bash', 'Read', 'TodoWrite', 'Other'][turn % 4 + 1] AS tool, CASE WHEN turn % 4 = 3 THEN regexp_replace('first=' || a, '\s+$', '') ELSE a END AS a FROM arg),
 shown AS (SELECT conv_id, turn, CASE WHEN tool = 'TodoWrite' OR a IN ('', '0') THEN tool ELSE tool || '(' || CASE WHEN length(a) > 140 THEN substr(a, 1, 140) || '…' ELSE a END || ')' END AS t FROM named),
 told AS (SELECT ev.conv_id, string_agg(CASE kind WHEN 'USER' THEN '🧑 ЮЗЕР: ' || ev.text WHEN 'ASSISTANT' THEN '🤖: ' || ev.text ELSE '  ↳: ' || shown.t END, chr(10) ORDER BY ev.turn, ev.pos) AS lines
  FROM ev LEFT JOIN shown ON kind = 'TOOL' AND shown.conv_id = ev.conv_id AND shown.turn = ev.turn WHERE kind <> 'THINKING' GROUP BY ev.conv_id),
 used AS (SELECT conv_id, string_agg(tool || '×' || n, ', ' ORDER BY n DESC, f) AS tools FROM (SELECT conv_id, tool, count(*) AS n, min(turn) AS f FROM ev WHERE kind = 'TOOL' GROUP BY conv_id, tool) GROUP BY conv_id),
 meta AS (SELECT conv_id, conv_id::VARCHAR AS session, CASE WHEN count(*) FILTER (role IN ('user', 'assistant')) > 0 THEN 's' || conv_id END AS sid,
  CASE WHEN count(*) FILTER (role IN ('user', 'assistant') AND turn >= 1) > 0 THEN '/w/p' || (conv_id % 7) END AS cwd, max(turn) - min(turn) AS m,
  strftime(TIMESTAMP '2024-03-01' + to_minutes(min(turn)), '%Y-%m-%dT%H:%M:%SZ') AS lo, strftime(TIMESTAMP '2024-03-01' + to_minutes(max(turn)), '%Y-%m-%dT%H:%M:%SZ') AS hi FROM conv GROUP BY conv_id),
 dg AS (SELECT session, '# ДАЙДЖЕСТ СЕССИИ (прототип жнеца)' || chr(10) || chr(10) || '- session: `' || coalesce(sid, '?') || '`' || chr(10) || '- cwd: `' || coalesce(cwd, '?') || '`  |  branch: `-`' || chr(10)
  || '- период: ' || lo || ' → ' || hi || '  (~' || CASE WHEN m >= 60 THEN (m // 60) || 'ч ' || (m % 60) || 'м' ELSE m || 'м' END || ')' || chr(10)
  || '- объём: промптов=' || user_prompts || ', реплик=' || assistant_texts || ', tool-вызовов=' || tool_calls || ', thinking-блоков выкинуто=' || thinking || ', tool-результатов выкинуто=' || tool_results || chr(10)
  || '- инструменты: ' || coalesce(tools, '') || chr(10) || chr(10) || '## Хронология (сжатая)' || chr(10) || chr(10) || lines AS digest
  FROM c JOIN meta USING (session) JOIN told USING (conv_id) LEFT JOIN used USING (conv_id) WHERE user_prompts >= 2)"""


@query("f35_render_digest", _DIGEST + " SELECT * FROM dg")
def render_digest(spark, sf_dir):
    return R.digest(A.transcript_lines(spark, sf_dir))


@query("a9_compression_ratio", _DIGEST + r""", raw AS (SELECT conv_id::VARCHAR AS session, sum(octet_length(encode('{"type":' || to_json(role) || ',"timestamp":"2024-03-01T00:00:00Z","sessionId":"s' || conv_id || '","cwd":"' || CASE WHEN turn >= 1 THEN '/w/p' || conv_id % 7 ELSE '' END
  || '","message":{"content":' || CASE WHEN role = 'assistant' THEN '[{"type":"thinking","text":"t"},{"type":"text","text":' || to_json(text) || '}' || CASE WHEN turn % 2 = 1 THEN ',{"type":"tool_use","name":"' || ['Bash', 'Read', 'TodoWrite', 'Other'][turn % 4 + 1]
  || '","input":{"' || ['command', 'file_path', 'todos', 'first'][turn % 4 + 1] || '":' || to_json(substr(text, 1, 200)) || ',"a":1}}' ELSE '' END || ']' ELSE to_json(text) END || '}}')) + 1) AS n FROM conv GROUP BY conv_id)
 SELECT session, (100 * octet_length(encode(digest)) // greatest(n, 1))::BIGINT AS percent FROM dg JOIN raw USING (session)""")
def compression(spark, sf_dir):
    lines = A.transcript_lines(spark, sf_dir)
    return R.compression(R.digest(lines), lines)


@query("x3_summarize", _DIGEST + """, l AS (SELECT session, string_split(digest, chr(10)) AS l FROM dg) SELECT session, 'misc' AS project,
 coalesce(substr(list_filter(l, lambda x: starts_with(x, '🧑'))[1], 1, 400), '') AS current_state, coalesce(substr(l[-1], 1, 400), '') AS session_summary FROM l""")
def summarize(spark, sf_dir):
    return R.extractive_summary(R.digest(A.transcript_lines(spark, sf_dir)))


# ---- sweep, journal -------------------------------------------------------------------------------------------------


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.eligible(A.listing(spark, sf_dir), A.sweep_state(spark, sf_dir), A.now())


@query("s5_scan_transcript_listing", _with(A.LISTING) + " SELECT path, size, row_number() OVER (ORDER BY mtime DESC, path) AS pos FROM files")
def listing(spark, sf_dir):
    hour = F.date_trunc("hour", "mtime")
    return N.positions(A.listing(spark, sf_dir), [F.desc("mtime"), F.col("path")], hour).select("path", "size", "pos")


@query("s5_scan_folder", "SELECT conv_id::VARCHAR AS session, sum(octet_length(encode(role)) + 1)::BIGINT AS size FROM conversations GROUP BY conv_id")
def scan_folder(spark, sf_dir):
    """Real files, a transcript each, listed with their sizes; contents aren't read."""
    folder = _store(spark, "transcripts")
    turns = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), "role")
    turns.repartition("session").write.partitionBy("session").text(folder)
    return files.listing(spark, f"{folder}/*/part-*").select(F.regexp_extract("path", "session=([^/]*)/", 1).alias("session"), "size")


@query("j3_sweep_state_join", _with(A.LISTING) + " SELECT f.path, coalesce(s.size, -1) AS seen FROM files f LEFT JOIN state s USING (path)")
def state_join(spark, sf_dir):
    return A.listing(spark, sf_dir).join(A.sweep_state(spark, sf_dir).select("path", F.col("size").alias("seen")), "path", "left").select("path", F.coalesce("seen", F.lit(-1)).alias("seen"))


@query("p8_idle_filter", _with(A.LISTING) + " SELECT path FROM files WHERE date_diff('second', mtime, TIMESTAMP '2024-03-01') >= 900")
def idle(spark, sf_dir):
    return J.eligible(A.listing(spark, sf_dir), A.sweep_state(spark, sf_dir).limit(0), A.now()).select("path")


@query("p9_growth_filter", _with(A.LISTING) + " SELECT path FROM eligible")
def growth(spark, sf_dir):
    return _eligible(spark, sf_dir).select("path")


@query("p10_sentinel_filter", _with(A.LISTING) + " SELECT path FROM files WHERE size <= 500000 AND sentinel")
def sentinel(spark, sf_dir):
    return A.listing(spark, sf_dir).where(J.own_output(F.col("size"), F.col("raw"))).select("path")


@query("o3_sweep_cap6", _with(A.LISTING) + " SELECT path FROM eligible WHERE NOT (size <= 500000 AND sentinel) ORDER BY mtime DESC, path LIMIT 6")
def sweep_cap(spark, sf_dir):
    return J.sweep(A.listing(spark, sf_dir), A.sweep_state(spark, sf_dir), A.now()).select("path")


@query("t3_idempotent_sweep", _with(A.LISTING, "done AS (SELECT path, size FROM eligible WHERE NOT (size <= 500000 AND sentinel) ORDER BY mtime DESC, path LIMIT 6)") + " SELECT path, size, 'ok' AS res FROM state WHERE path NOT IN (SELECT path FROM done) UNION ALL SELECT path, size, 'ok' FROM done")
def idempotent_sweep(spark, sf_dir):
    return J.run_sweep(A.listing(spark, sf_dir), A.sweep_state(spark, sf_dir), A.now(), lambda paths: dict.fromkeys(paths, "ok"))


@query("o4_recent_projects12", _with(A.LISTING) + " SELECT path FROM files ORDER BY mtime DESC, path LIMIT 12")
def recent(spark, sf_dir):
    return J.recent_projects(A.listing(spark, sf_dir)).select("path")


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A journal and new entries: conversations by project, the later half of the turns being new."""
    c = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    i = F.col("conv_id")
    entry = lambda rows, seq, text: rows.select(F.concat(F.lit("p"), (i % 3).cast("string")).alias("project"), F.concat(F.lit("s"), i.cast("string")).alias("sid"), F.lit("2024-03-01").alias("date"), F.lit("5м").alias("dur"), F.concat(F.lit(text), F.col("n").cast("string")).alias("summary"), seq.alias("seq"))
    return entry(c.where("conv_id % 4 <> 3"), i, "old "), entry(c.where("conv_id % 2 = 1"), i + 1_000_000_000, "new ")


_JOURNAL = """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
e AS (SELECT 'p' || conv_id % 3 AS project, 's' || conv_id AS sid, CASE WHEN conv_id % 2 = 1 THEN 'new ' ELSE 'old ' END || n AS summary,
  CASE WHEN conv_id % 2 = 1 THEN conv_id + 1000000000 ELSE conv_id END AS seq FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq DESC) AS nth FROM e)"""


@query("t4_journal_upsert", _JOURNAL + " SELECT project, sid, summary, seq FROM r WHERE nth <= 15")
def journal_upsert(spark, sf_dir):
    return J.upsert(*_entries(spark, sf_dir))[0].select("project", "sid", "summary", "seq")


@query("s8_sink_archive", """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
o AS (SELECT 'p' || conv_id % 3 AS project, 's' || conv_id AS sid, 'old ' || n AS summary, conv_id AS seq, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id DESC) AS nth FROM c WHERE conv_id % 4 <> 3),
b AS (SELECT project, sid, summary, seq FROM o WHERE nth <= 15 AND sid NOT IN (SELECT 's' || conv_id FROM c WHERE conv_id % 2 = 1)
  UNION ALL SELECT 'p' || conv_id % 3, 's' || conv_id, 'new ' || n, conv_id + 1000000000 FROM c WHERE conv_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq DESC) AS nth FROM b)
SELECT project, sid, summary, seq FROM o WHERE nth > 15 UNION ALL SELECT project, sid, summary, seq FROM r WHERE nth > 15""")
def archive(spark, sf_dir):
    """Two runs, each of which appends what overflows."""
    folder = _store(spark, "archive")
    old, new = _entries(spark, sf_dir)
    journal = old.limit(0)
    for entries in (old, new):
        journal, overflow = J.upsert(journal, entries)
        J.append_archive(overflow, folder)
    return spark.read.schema("sid string, summary string, seq long, project string").json(folder).select("project", "sid", "summary", "seq")


@query("w2_journal_retention", _JOURNAL + " SELECT project, least(count(*), 15) AS kept, greatest(count(*) - 15, 0) AS overflow FROM r GROUP BY project")
def retention(spark, sf_dir):
    kept, over = J.upsert(*_entries(spark, sf_dir))
    both = kept.select("project", F.lit(1).alias("k")).union(over.select("project", F.lit(0).alias("k")))
    return both.groupBy("project").agg(F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("overflow"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = J.upsert(*_entries(spark, sf_dir))
    states = kept.select("project").distinct().withColumn("current_state", F.concat(F.lit("state of "), "project", F.lit("\nmore")))
    return J.render(kept, states)


@query("s7_sink_session_doc", _JOURNAL + """ SELECT project, md5('# Сессии: ' || project || chr(10) || '<!-- AUTO-HARVEST (launchd-свипер). Канон recall. Руками не править — перезапишется. -->' || chr(10) || chr(10)
 || '## 🔖 Текущее состояние' || chr(10) || 'state of ' || project || chr(10) || 'more' || chr(10) || chr(10) || '## Журнал' || chr(10)
 || string_agg(chr(10) || '### 2024-03-01 · ' || sid || ' · 5м' || chr(10) || summary, chr(10) ORDER BY seq DESC) || chr(10)) AS doc FROM r WHERE nth <= 15 GROUP BY project""")
def session_doc(spark, sf_dir):
    """The documents are written, a file each, and read back."""
    folder = _store(spark, "sessions")
    S.write_notes(_docs(spark, sf_dir).select(F.concat("project", F.lit(".md")).alias("file"), F.col("doc").alias("raw")), folder)
    read = S.scan_instincts(spark, folder)  # all notes of one folder
    return read.select(F.regexp_replace("file", r"\.md$", "").alias("project"), F.md5(F.col("raw").cast("binary")).alias("doc"))


@query("s6_scan_journal", _JOURNAL + " SELECT project, nth::INT AS pos, sid, '### 2024-03-01 · ' || sid || ' · 5м' AS header, summary AS body FROM r WHERE nth <= 15")
def scan_journal(spark, sf_dir):
    return J.parse(_docs(spark, sf_dir))


@query("w6_state_block_range", _JOURNAL + """ SELECT DISTINCT project, n::INT AS n, line FROM r, LATERAL (SELECT unnest(range(1, 5)) AS n, unnest(['## 🔖 Текущее состояние', 'state of ' || project, 'more', '']) AS line)""")
def state_block(spark, sf_dir):
    return J.state_block(_docs(spark, sf_dir))


@query("j7_longest_prefix_join", """WITH s AS (SELECT DISTINCT source AS slug FROM documents), n AS (SELECT DISTINCT source || lang AS name FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT source FROM documents UNION SELECT 'zzz')
 SELECT name, arg_max(slug, length(slug)) AS slug FROM n LEFT JOIN s ON starts_with(name, slug) GROUP BY name""")
def longest_prefix(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    names = d.where("lang IS NOT NULL").select(F.concat("source", "lang").alias("name")).union(d.select("source")).union(spark.createDataFrame([("zzz",)], "name string")).distinct()
    return J.longest_prefix(names, d.select(F.col("source").alias("slug")).distinct())


# ---- observations, instincts ----------------------------------------------------------------------------------------

_OBS = """o AS (SELECT event_id AS seq, ts, CASE WHEN event_id % 2 = 0 THEN 'tool_start' ELSE 'tool_complete' END AS event, CASE WHEN event_id % 5 <> 0 THEN event_type ELSE 'unknown' END AS tool,
 user_id::VARCHAR AS session, '/w/' || event_type || '/' || user_id AS cwd, CASE WHEN event_id % 2 = 0 THEN props END AS input, CASE WHEN event_id % 2 = 1 THEN props END AS output FROM events)"""


def _denied(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("# no",), ("",), ("/w/click/",), ("/w/view/1",)], "path string")


@query("j5_denylist_anti", _with(_OBS) + " SELECT seq FROM o WHERE NOT (starts_with(cwd, '/w/click/') OR cwd = '/w/view/1' OR starts_with(cwd, '/w/view/1/'))")
def denylist(spark, sf_dir):
    return O.not_denied(A.hook_events(spark, sf_dir), _denied(spark)).select("seq")


@query("t1_hook_event_ingest", _with(_OBS) + " SELECT seq, event, tool, session, input, output FROM o WHERE NOT (starts_with(cwd, '/w/click/') OR cwd = '/w/view/1' OR starts_with(cwd, '/w/view/1/'))")
def ingest(spark, sf_dir):
    """The stream itself, over files of hook events, until none is left."""
    folder = _store(spark, "hooks")
    A.hook_events(spark, sf_dir).write.parquet(f"{folder}/in")
    H.ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", _denied(spark)).awaitTermination()
    return spark.read.schema(H.OBSERVATION).parquet(f"{folder}/out").drop("timestamp")


@query("s9_sink_obs_append", _with(_OBS) + " SELECT seq, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, event, tool, session, input, output, seq % 3 < 2 AS archived FROM o")
def obs_append(spark, sf_dir):
    """Three batches are appended to a log that is full after each of them: the first two end up in its archive."""
    folder = _store(spark, "observations")
    observed = O.observe(A.hook_events(spark, sf_dir))
    for k in range(3):
        files.append_rotated(O.log_lines(observed.where(F.col("seq") % 3 == k)), folder, 1, "2024-03-01T000000Z")
    read = files.read_rotated(spark, folder).select("archived", F.from_json("value", H.OBSERVATION.replace("timestamp timestamp", "timestamp string")).alias("o"))
    return read.select("o.*", "archived")


@query("p11_self_loop_filter", "SELECT event_id FROM events WHERE event_id % 4 NOT IN (0, 1)")
def self_loop(spark, sf_dir):
    i = F.col("event_id") % 4
    raw = F.when(i == 0, "").when(i == 1, '{"x":"lorekeep"}').otherwise(F.col("props"))
    return O.guard(A.table(spark, sf_dir, "events").withColumn("raw", raw)).select("event_id")


@query("p12_event_case", _with(_OBS) + " SELECT event, count(*) AS n, count(input) AS inputs, count(output) AS outputs FROM o GROUP BY event")
def event_case(spark, sf_dir):
    return O.observe(A.hook_events(spark, sf_dir)).groupBy("event").agg(F.count("*").alias("n"), F.count("input").alias("inputs"), F.count("output").alias("outputs"))


@query("p14_min_obs_gate", _with(_OBS) + " SELECT seq FROM o WHERE (SELECT count(*) FROM o) >= 10")
def min_obs(spark, sf_dir):
    batch = O.observe(A.hook_events(spark, sf_dir))
    few = batch.where("seq < 5")
    return O.gated(batch).select("seq").union(O.gated(few).select("seq"))


@query("p15_byte_tail", "WITH l AS (SELECT event_id AS seq, sum(octet_length(encode(props)) + 1) OVER (ORDER BY event_id DESC) AS s FROM events) SELECT seq FROM l WHERE s <= 120000")
def byte_tail(spark, sf_dir):
    return O.byte_tail(A.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("line"))).select("seq")


@query("p16_event_router", "SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN ['capture', 'testrun'] WHEN 1 THEN ['capture', 'context'] ELSE ['capture'] END) AS handler FROM events")
def router(spark, sf_dir):
    m = F.element_at(F.array(F.lit("Bash"), F.lit("clear"), F.lit("Read")), (F.col("event_id") % 3 + 1).cast("int"))
    return O.route(A.table(spark, sf_dir, "events").withColumn("matcher", m)).select("event_id", "handler")


@query("p17_background_guard", "SELECT event_id FROM events WHERE event_id % 6 NOT IN (0, 2, 3, 4)")
def background(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumn("analyzing", F.when(F.col("event_id") % 2 == 0, F.lit(True))).withColumn("background", F.col("event_id") % 3 == 0)
    return O.foreground(e).select("event_id")


_SHAPES = _with(_OBS, "n AS (SELECT tool, regexp_replace(input, '[0-9]+', 'N', 'g') AS shape, count(*) AS n FROM o WHERE event = 'tool_start' GROUP BY ALL), t AS (SELECT tool, sum(n) AS t FROM n GROUP BY tool)")


@query("a11_repeat_pattern", _SHAPES + " SELECT n.tool, shape, n, round(greatest(0.3, least(0.9, n / t)), 2)::DOUBLE AS confidence FROM n JOIN t USING (tool) WHERE n >= 3")
def repeat_pattern(spark, sf_dir):
    return O.repeated_patterns(O.observe(A.hook_events(spark, sf_dir)))


@query("x4_distill", _SHAPES + " SELECT n.tool || ' ' || shape AS id, round(greatest(0.3, least(0.9, n / t)), 2)::DOUBLE AS confidence FROM n JOIN t USING (tool) WHERE n >= 3")
def distill(spark, sf_dir):
    return O.repeated_patterns(O.observe(A.hook_events(spark, sf_dir))).select(F.concat("tool", F.lit(" "), "shape").alias("id"), "confidence")


def _instincts(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed = A.proposals(spark, sf_dir)
    known = proposed.where("seq < 40 AND seq % 2 = 0").select(T.slug_id(F.col("id")).alias("id")).distinct().select(
        "id", F.lit("0.40").cast("decimal(4,2)").alias("confidence"), F.lit("old").alias("trigger"), F.lit("d").alias("domain"), F.lit("Old").alias("title"), F.lit("a").alias("action"), F.lit("e").alias("evidence"), F.lit("2020-01-01").cast("date").alias("last_observed"))
    return O.merge_instincts(known, proposed, F.to_date(A.now()))


_INSTINCTS = r"""WITH p AS (SELECT event_id AS seq, 'habit-' || user_id % 97 || '-' || regexp_replace(lower(event_type), '[^a-z0-9]+', '-', 'g') AS id, event_id % 3 <> 0 AS full_,
  CASE WHEN event_id % 11 = 0 OR event_id % 12 = 0 THEN 0.3 ELSE greatest(0.3, least(0.9, (event_id % 12) / 10.0)) END::DOUBLE AS conf, event_type FROM events),
k AS (SELECT DISTINCT id FROM p WHERE seq < 40 AND seq % 2 = 0),
g AS (SELECT id, list({'c': conf, 'f': full_, 't': event_type} ORDER BY seq) AS rows_ FROM p GROUP BY id),
f AS (SELECT g.id, list_reduce(rows_, lambda a, x: CASE WHEN NOT a.f AND NOT x.f THEN a
    WHEN a.f THEN {'c': round(greatest(0.3, least(0.9, greatest(a.c, x.c) + 0.05)), 2)::DOUBLE, 'f': true, 't': CASE WHEN x.f THEN x.t ELSE a.t END}
    ELSE {'c': round(x.c, 2)::DOUBLE, 'f': true, 't': x.t} END, {'c': CASE WHEN k.id IS NULL THEN 0.0 ELSE 0.4 END::DOUBLE, 'f': k.id IS NOT NULL, 't': NULL::VARCHAR}) AS r
  FROM g LEFT JOIN k ON k.id = g.id),
i AS (SELECT id, r.c AS confidence, coalesce('when ' || r.t, 'old') AS trigger FROM f WHERE r.f)"""


@query("t5_instinct_merge", _INSTINCTS + " SELECT * FROM i")
def instinct_merge(spark, sf_dir):
    return _instincts(spark, sf_dir).select("id", F.col("confidence").cast("double").alias("confidence"), "trigger")


@query("j6_instinct_merge_join", _INSTINCTS + " SELECT g.id, k.id IS NOT NULL AS known, bool_or(full_) AS has_content FROM g JOIN p USING (id) LEFT JOIN k ON k.id = g.id GROUP BY ALL")
def merge_join(spark, sf_dir):
    p = A.proposals(spark, sf_dir).withColumn("id", T.slug_id(F.col("id")))
    known = p.where("seq < 40 AND seq % 2 = 0").select("id").distinct().withColumn("_k", F.lit(True))
    return p.groupBy("id").agg(F.bool_or(F.col("action") != "").alias("has_content")).join(known, "id", "full").select("id", F.coalesce("_k", F.lit(False)).alias("known"), "has_content")


@query("p18_min_content_filter", _INSTINCTS + " SELECT count(*) AS n FROM i")
def min_content(spark, sf_dir):
    return _instincts(spark, sf_dir).agg(F.count("*").alias("n"))


_CARDS = _INSTINCTS + ", c AS (SELECT id || '.md' AS file, confidence FROM i WHERE confidence >= 0.5)"


@query("s10_scan_instincts", _INSTINCTS + " SELECT id || '.md' AS file, confidence FROM i")
def scan_instincts(spark, sf_dir):
    files = O.render_instinct(_instincts(spark, sf_dir))
    return files.select("file", T.parse_confidence(F.col("raw")).alias("confidence"))


@query("p13_confidence_threshold", _CARDS + " SELECT file, confidence FROM c")
def trusted(spark, sf_dir):
    return O.cards(O.render_instinct(_instincts(spark, sf_dir))).select("file", "confidence")


@query("o2_instincts_top25", _CARDS + " SELECT file, confidence FROM c ORDER BY confidence DESC, file LIMIT 25")
def top25(spark, sf_dir):
    return O.top_cards(O.render_instinct(_instincts(spark, sf_dir))).select("file", "confidence")


@query("f30_instinct_card", _CARDS + """, t AS (SELECT i.*, replace(id, '-', ' ') AS s FROM i WHERE confidence >= 0.5) SELECT id || '.md' AS file,
 '- (' || printf('%.2f', confidence) || ') **' || CASE WHEN trigger = 'old' THEN 'Old' ELSE upper(substr(s, 1, 1)) || lower(substr(s, 2)) END || '** — ' || CASE WHEN trigger = 'old' THEN 'a' ELSE 'do it' END AS card FROM t""")
def card(spark, sf_dir):
    return O.cards(O.render_instinct(_instincts(spark, sf_dir))).select("file", "card")


@query("f31_trigger_extract", _INSTINCTS + " SELECT id || '.md' AS file, substr(trigger, 1, 90) AS trigger FROM i")
def trigger(spark, sf_dir):
    return O.render_instinct(_instincts(spark, sf_dir)).select("file", O.trigger_of(F.col("raw")).alias("trigger"))


# ---- test runs, context ---------------------------------------------------------------------------------------------

_RUNS = """WITH r AS (SELECT event_id AS seq, 'repo' || user_id % 50 AS repo, strftime(ts, '%Y-%m-%d %H:%M') AS at_, event_id AS i,
 CASE event_id % 6 WHEN 0 THEN (i % 40 + 5) || ' тестов: ' || (i % 40 + 5 - i % 5) || ' ok, ' || (i % 5) || ' FAILED' || CASE WHEN i % 12 = 0 THEN ', 2 skip' ELSE '' END
 WHEN 1 THEN 'pytest: ' || (i % 30) || ' ok' || CASE WHEN i % 4 > 0 THEN ', ' || (i % 4) || ' FAILED' ELSE '' END
 WHEN 2 THEN 'pytest: ' || (i % 30) || ' ok' WHEN 3 THEN 'gradle test: зелёный (BUILD SUCCESSFUL)' WHEN 4 THEN 'gradle: НЕ СКОМПИЛИРОВАЛОСЬ' END AS result,
 CASE WHEN i % 6 >= 3 THEN './gradlew test' ELSE 'python -m pytest -q' END AS cmd FROM events),
l AS (SELECT seq, repo, at_ || ' | ' || result || ' | ' || cmd AS line, row_number() OVER (PARTITION BY repo ORDER BY seq DESC) AS nth FROM r WHERE result IS NOT NULL)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.test_runs(A.run_outputs(spark, sf_dir))


@query("f27_testrun_extract", _RUNS + " SELECT seq, repo, line FROM l")
def testruns(spark, sf_dir):
    return _runs(spark, sf_dir)


_KEPT = _RUNS + " SELECT seq, repo, line FROM l WHERE nth <= 30"


@query("s13_sink_testrun", _KEPT)
def sink_testrun(spark, sf_dir):
    """The log is written and read back."""
    store = _store(spark, "runs")
    state.save(O.latest_runs(_runs(spark, sf_dir), DEFAULTS.kept_runs), store)
    return state.load(spark, store, "seq long, repo string, line string")


@query("t6_bounded_log_retention", _KEPT)
def bounded_log(spark, sf_dir):
    """The stream that keeps the log up, over files of test outputs."""
    folder = _store(spark, "runs")
    A.run_outputs(spark, sf_dir).write.parquet(f"{folder}/in")
    H.keep_runs(spark, f"{folder}/in", f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return state.load(spark, f"{folder}/log", "seq long, repo string, line string")


@query("w3_testrun_retention", _RUNS + " SELECT repo, least(count(*), 30) AS n FROM l GROUP BY repo")
def testrun_retention(spark, sf_dir):
    return O.latest_runs(_runs(spark, sf_dir), DEFAULTS.kept_runs).groupBy("repo").agg(F.count("*").alias("n"))


@query("w7_tail_n_runs", _RUNS + " SELECT seq, repo, line FROM l WHERE nth <= 3")
def tail_runs(spark, sf_dir):
    return O.latest_runs(_runs(spark, sf_dir), DEFAULTS.shown_runs)


@query("j9_testrun_join", _RUNS + ", n AS (SELECT 'repo' || unnest(range(60)) AS name) SELECT name, coalesce(seq, -1) AS seq, line FROM n LEFT JOIN (SELECT * FROM l WHERE nth <= 3) x ON x.repo = name")
def testrun_join(spark, sf_dir):
    names = spark.range(60).select(F.concat(F.lit("repo"), F.col("id").cast("string")).alias("name"))
    return O.context_runs(names, _runs(spark, sf_dir)).select("name", F.coalesce("seq", F.lit(-1)).alias("seq"), "line")


# ---- stored tables --------------------------------------------------------------------------------------------------


def _store(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares; only on a single machine, without one, in this machine's. Spark
    removes it when the application ends."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    folder = f"{base}/lorekeep-{spark.sparkContext.applicationId}"
    fs, at = files.at(spark, folder)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@query("s3_sink_index", _with(A.CHUNKS) + " SELECT file, count(*) AS chunks FROM chunks GROUP BY file")
def sink_index(spark, sf_dir):
    store = _store(spark, "index")
    M.save_index(*N.build_index(A.notes(spark, sf_dir), *M.load_index(spark, store), M.MODEL), store)
    return M.load_index(spark, store)[1].groupBy("file").agg(F.count("*").alias("chunks"))


@query("s2_scan_index", _with(A.NOTES) + " SELECT file, substr(sha256(raw), 1, 16) AS hash FROM notes")
def scan_index(spark, sf_dir):
    store = _store(spark, "index")
    notes = A.notes(spark, sf_dir)
    M.save_index(N.file_table(notes, M.MODEL), spark.createDataFrame([], M.CHUNKS), store)
    files, _ = M.load_index(spark, store)
    none, _ = M.load_index(spark, _store(spark, "missing"))
    return files.unionByName(none).select("file", "hash")


@query("s15_state_load_save", _with(A.LISTING) + " SELECT path, size FROM state UNION ALL SELECT path, size FROM files WHERE doc_id % 2 = 1")
def state_load_save(spark, sf_dir):
    store = _store(spark, "state")
    schema = "path string, size long, res string"
    state.save(A.sweep_state(spark, sf_dir), store)
    more = A.listing(spark, sf_dir).where("doc_id % 2 = 1").select("path", "size", F.lit("ok").alias("res"))
    state.save(state.load(spark, store, schema).unionByName(more), store)
    return state.load(spark, store, schema).select("path", "size")


@query("t2_gated_microbatch", _with(_OBS) + ", t AS (SELECT seq, sum(octet_length(encode(coalesce(input, output))) + 1) OVER (ORDER BY seq DESC) AS s FROM o) SELECT seq FROM t WHERE s <= 120000 AND (SELECT count(*) FROM o) >= 10")
def gated_microbatch(spark, sf_dir):
    batch = O.gated(O.observe(A.hook_events(spark, sf_dir)))
    return O.byte_tail(batch.select("seq", F.coalesce("input", "output").alias("line"))).select("seq")


# ---- settings -------------------------------------------------------------------------------------------------------


@query("s14_kv_env_scan", "SELECT 'k' || i % 20 AS key, arg_max(i || '=x', i) AS value FROM (SELECT event_id AS i FROM events) WHERE i % 5 <> 0 GROUP BY key")
def kv_env(spark, sf_dir):
    i = F.col("event_id")
    line = F.when(i % 5 == 0, F.lit("# k1=9")).otherwise(F.concat(F.lit(" k"), (i % 20).cast("string"), F.lit(" = "), i.cast("string"), F.lit("=x ")))
    return S.key_values(A.table(spark, sf_dir, "events").select(i.alias("line_no"), line.alias("line")))


@query("u4_overlay_merge", "SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NOT NULL THEN 'over' ELSE 'base' END AS value FROM (SELECT DISTINCT user_id % 40 AS k FROM events) a FULL JOIN (SELECT DISTINCT user_id % 60 AS k FROM events WHERE user_id % 2 = 0) b ON a.k = b.k")
def overlay(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return O.overlay(e.select((F.col("user_id") % 40).alias("key")).distinct().withColumn("value", F.lit("base")), e.where("user_id % 2 = 0").select((F.col("user_id") % 60).alias("key")).distinct().withColumn("value", F.lit("over")))


@query("f34_first_key_backend", "SELECT event_type AS key FROM (SELECT DISTINCT event_type FROM events) WHERE event_type IN ('purchase', 'click') ORDER BY event_type DESC LIMIT 1")
def first_backend(spark, sf_dir):
    settings = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("key")).distinct().withColumn("value", F.lit("x"))
    return O.first_backend(settings, ["none", "purchase", "click"])


