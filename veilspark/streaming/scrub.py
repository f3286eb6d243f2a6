"""Scrubbing and scanning files as they arrive."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.sql import name
from ..operators.chunking import READ_CHUNK, READ_OVERLAP, chunked_findings
from ..operators.classify import sensitive_columns
from ..operators.scrub import observed, plan_levels, scrub
from ..policy import DEFAULT_PRESET


#: column of the folders that batches are written to
BATCH = "batch_number"


def freeze_policy(spark: SparkSession, path: str, levels: dict[str, str]) -> dict[str, str]:
    """Levels a stream started with: stored at the first start, read at every later one."""
    spark.range(1).select(F.lit(json.dumps(levels)).alias("value")).coalesce(1).write.mode("ignore").text(path)
    return json.loads(spark.read.text(path).first()[0])


def frozen_policy(spark: SparkSession, path: str) -> dict[str, str] | None:
    """The levels stored by ``freeze_policy``, None before that."""
    try:
        row = spark.read.text(path).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return json.loads(row[0]) if row else None


class RunningCounters(StreamingQueryListener):
    """Sums up what every micro-batch of observed streams reports."""

    def __init__(self, metrics: str = "scrub"):
        self.metrics = metrics
        self.totals: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.metrics)
        for key, value in (row.asDict() if row else {}).items():
            self.totals[key] = self.totals.get(key, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def scrub_stream(stream: DataFrame, levels: dict[str, str], target: str, checkpoint: str,
                 token_key: str | None = None, fmt: str = "parquet", metrics: str = "scrub",
                 **options) -> StreamingQuery:
    """Scrub whatever has arrived, then stop; run again for what comes later.

    The levels are frozen next to the checkpoint, so a restart cannot change
    how a column is masked. Masks keep no state; the checkpoint makes sure that
    every input file is written exactly once.
    """
    frozen = freeze_policy(stream.sparkSession, f"{checkpoint}/policy", levels)
    masked = scrub(observed(stream, frozen, metrics), frozen, token_key, **options)
    return (masked.writeStream.format(fmt).option("path", target)
            .option("checkpointLocation", f"{checkpoint}/state")
            .trigger(availableNow=True).outputMode("append").start())


def scrub_batch(batch: DataFrame, number: int, target: str, checkpoint: str, preset: str = DEFAULT_PRESET,
                token_key: str | None = None, row_key: str | Sequence[str] = (), **options) -> None:
    """Scrub one batch into a folder of its own number and enter its counts in the ledger, ``checkpoint/ledger``.

    A batch that runs again, after a failure at any point, overwrites both.
    """
    spark = batch.sparkSession
    levels = frozen_policy(spark, f"{checkpoint}/policy")
    if levels is None:
        if batch.isEmpty():
            return
        levels = freeze_policy(spark, f"{checkpoint}/policy", plan_levels(sensitive_columns(batch, row_key), preset))
    metrics = Observation()
    masked = scrub(observed(batch, levels, metrics), levels, token_key, **options)
    masked.write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")
    counted = [(k, int(v)) for k, v in metrics.get.items()]
    (spark.createDataFrame(counted, "counter string, n bigint").coalesce(1)
     .write.mode("overwrite").parquet(f"{checkpoint}/ledger/{BATCH}={number}"))


def scrub_arriving(stream: DataFrame, target: str, checkpoint: str, preset: str = DEFAULT_PRESET,
                   token_key: str | None = None, row_key: str | Sequence[str] = (), **options) -> StreamingQuery:
    """Scrub a stream that nobody has classified: its first rows are, and what they say holds for all that follow.

    The first batch with rows is classified, but for the columns of ``row_key``, and the policy is stored before anything
    is written; later batches and restarts read it. Every row is written and counted once, see ``scrub_batch``;
    ``read_scrubbed`` and ``counters`` read the results. The stream may come in any number of batches; without rows nothing is written.
    """
    def one(batch: DataFrame, number: int) -> None:
        scrub_batch(batch, number, target, checkpoint, preset, token_key, row_key, **options)
    return (stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/state")
            .trigger(availableNow=True).start())


def read_scrubbed(spark: SparkSession, target: str) -> DataFrame:
    """What ``scrub_arriving`` has written."""
    return spark.read.option("basePath", target).parquet(f"{target}/{BATCH}=*").drop(BATCH)


def counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(counter, n): rows (``_rows``) and filled cells per sensitive column of all batches so far, each batch once."""
    path = f"{checkpoint}/ledger"
    ledger = spark.read.option("basePath", path).parquet(f"{path}/{BATCH}=*")
    return ledger.groupBy("counter").agg(F.sum("n").alias("n"))


def scan_stream(stream: DataFrame, text: str, target: str, checkpoint: str, fmt: str = "parquet",
                size: int = READ_CHUNK, overlap: int = READ_OVERLAP) -> StreamingQuery:
    """Findings of documents as they arrive, long documents in chunks with margins.

    Findings are in document offsets, each from the chunk that owns its start, and
    no state is kept for that.
    """
    found = stream.withColumn("findings", F.expr(chunked_findings(name(text), size, overlap))).drop(text)
    return (found.writeStream.format(fmt).option("path", target)
            .option("checkpointLocation", f"{checkpoint}/state")
            .trigger(availableNow=True).outputMode("append").start())
