"""Thin command line: ``python -m lorekeep.cli VERB --folder F --store S``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import notes as N
from lorekeep.plans import maintain as M


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lorekeep")
    p.add_argument("verb", choices=("index", "recall", "lifecycle", "link", "graph", "maintain"))
    p.add_argument("query", nargs="*")
    p.add_argument("--folder", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("-k", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.verb == "index":
        print(M.index(spark, a.folder, a.store).first().asDict())
    elif a.verb == "recall":
        hit = N.format_hit(F.col("score"), F.col("file"), F.col("heading"), F.col("text"))
        for r in M.recall(spark, a.store, [" ".join(a.query)], a.k).orderBy("rank").select(hit.alias("hit")).collect():
            print(r.hit, end="\n\n")
    elif a.verb == "lifecycle":
        for r in M.lifecycle(spark, a.folder, a.store, F.current_timestamp()).orderBy("section", "pos").toLocalIterator():
            print(r.line)
    elif a.verb == "link":
        print(M.link(spark, a.folder, a.store))
    elif a.verb == "graph":
        for r in M.graph(spark, a.folder, a.store).orderBy("file", F.desc("score"), "target").toLocalIterator():
            print(r.file, r.target, f"{r.score:.6f}", sep="\t")
    else:
        print(M.maintain(spark, a.folder, a.store, F.current_timestamp()) or "disabled or running, nothing done")


if __name__ == "__main__":
    main()
