"""Operator 8: removal of repeated lines by overlapping windows of three.

Every three consecutive lines of a text are a window. A window that occurs more than once in the corpus keeps its
first occurrence (least doc_id, then text, then position); the lines of all later ones are removed, as the union
of the positions they cover. Only DataFrame functions are used: windows are hashed where the text is read
(128 bits), counted with partial aggregation, and the rare repeated ones meet their occurrences in a join both of
whose sides have an exchange, so that adaptive execution can split a window that a large part of all texts hold.

Cases: a null text stays null; a text of fewer than three lines has no window and stays; windows without a word
don't count; rows equal in doc_id and text count as one occurrence and share its outcome; a text all of whose
lines go becomes empty; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import join_split, read

LINES = 3


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("_text_hash", F.xxhash64("text")).withColumn("_lines", F.split("text", "\n", -1))


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, _text_hash, pos, h1, h2) of every window with a word in it."""
    lines, n = F.col("_lines"), F.size("_lines") - (LINES - 1)
    part = lambda k: F.slice(lines, k, n)
    two = F.zip_with(part(1), part(2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def hashed(p: Column, c: Column) -> Column:
        return F.struct(
            F.xxhash64(p["a"], p["b"], c).alias("h1"),
            F.xxhash64(F.lit(LINES), c, p["b"], p["a"]).alias("h2"),
            F.concat(p["a"], p["b"], c).rlike(r"[^\s]").alias("has_word"),
        )

    keyed = _keyed(docs).where(n >= 1)
    return (
        keyed.select("doc_id", "_text_hash", F.posexplode(F.zip_with(two, part(3), hashed)).alias("pos", "w"))
        .where("w.has_word")
        .select("doc_id", "_text_hash", "pos", "w.h1", "w.h2")
    )


def later_occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, _text_hash, pos) of every repeated window but its first occurrence."""
    occurrence = F.struct("doc_id", "_text_hash", "pos")
    found = windows(docs)
    repeated = (
        found.groupBy("h1", "h2")
        .agg(F.min(occurrence).alias("_first"), F.max(occurrence).alias("_last"))
        .where(~F.col("_first").eqNullSafe(F.col("_last")))
        .select("h1", "h2", "_first")
    )
    return join_split(found, repeated, ["h1", "h2"]).where(~occurrence.eqNullSafe(F.col("_first"))).select("doc_id", "_text_hash", "pos")


def _without(docs: DataFrame) -> DataFrame:
    """(row: all columns of docs, n_lines, n_removed, text: without the covered lines)."""
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.array(*[p + k for k in range(LINES)]))))
    gone = (
        later_occurrences(docs)
        .groupBy("doc_id", "_text_hash")
        .agg(F.collect_set("pos").alias("_starts"))
        .select(F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_hash"), covered.alias("_covered"))
    )
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text_hash"))
    joined = rows.join(gone, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_text_hash").eqNullSafe(F.col("_hash")), "left")
    lined = joined.select("row", "_covered", F.split("row.text", "\n", -1).alias("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    picked = F.transform(kept, lambda i: F.get(F.col("_lines"), i))
    return lined.select(
        "row",
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_covered").isNull(), F.col("row.text")).otherwise(F.array_join(picked, "\n")).alias("text"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text: every text without the lines of windows that occurred before."""
    return _without(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_removed", "text")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without repeated lines; a text that loses all its lines loses its row."""
    left = _without(docs).where("n_removed = 0 OR n_removed < n_lines")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"))


#: For texts whose documents differ in doc_id.
SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS pos, l FROM d WHERE len(l) >= 3),
k AS (SELECT doc_id, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] AS win FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth
      FROM k WHERE regexp_matches(win, '[^\s]')),
g AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM r WHERE nth > 1),
c AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(
           list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]),
           chr(10)) END AS text
FROM d LEFT JOIN c USING (doc_id)
"""
