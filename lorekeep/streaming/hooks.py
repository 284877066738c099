"""Streams of hook events: filtered ingest, gated micro-batches, bounded logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorekeep.config import DEFAULTS, Settings
from lorekeep.operators import observations as O
from lorekeep.sources import files, state

EVENT = "seq long, ts timestamp, event string, cwd string, tool_name string, tool string, session_id string, input string, output string"
OBSERVATION = "seq long, timestamp timestamp, event string, tool string, session string, input string, output string"


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, denied: DataFrame) -> StreamingQuery:
    """Append observations of all new files in ``source`` to ``sink``; ends when none is left. The same expressions as in a
    batch run: each micro-batch joins the static denylist. A batch that runs again after a failure replaces its rows."""

    def append(batch: DataFrame, number: int) -> None:
        files.put_batch(O.observe(O.not_denied(batch, denied)), sink, number)

    stream = spark.readStream.schema(EVENT).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distill(spark: SparkSession, source: str, pending: str, checkpoint: str, handle: Callable[[DataFrame], None], s: Settings = DEFAULTS) -> StreamingQuery:
    """Hand observations to ``handle`` once there are enough; too few wait in the table ``pending`` for the next batch, so
    that none is lost. A batch that runs again after a failure finds its rows once."""

    def step(batch: DataFrame, _: int) -> None:
        waiting = state.load(spark, pending, OBSERVATION)
        rows = waiting.unionByName(batch).dropDuplicates(["seq"])
        if rows.limit(s.least_observations).count() < s.least_observations:
            state.save(rows, pending)
            return
        handle(rows)
        state.save(spark.createDataFrame([], OBSERVATION), pending)

    stream = spark.readStream.schema(OBSERVATION).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_runs(spark: SparkSession, source: str, log: str, checkpoint: str, s: Settings = DEFAULTS) -> StreamingQuery:
    """The last test runs of each repo, kept up as new ones arrive."""
    payload = "seq long, ts timestamp, cwd string, cmd string, output string"

    def step(batch: DataFrame, _: int) -> None:
        old = state.load(spark, log, "seq long, repo string, line string")
        state.save(O.latest_runs(old.unionByName(O.test_runs(batch)).dropDuplicates(["seq"]), s.kept_runs), log)

    stream = spark.readStream.schema(payload).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
