"""Continuous scoring of arriving customer records (Structured Streaming).

The online endpoints of the reference (score one customer / a list of
customers, with reasons) become one stateless streaming job:

    readStream(schema) -> validate (valid | quarantine) -> defaults ->
    online total rule -> features (record or fitted high-value mode) ->
    score (linear or trees) -> label / risk -> top-n reasons -> append sinks

Both sinks are fed by one query: a micro-batch is read and validated once, and its rows go
to a folder of their own in each sink, named by the batch id. A batch that is run again
after a failure overwrites its folders, and counts only once its commit record is
written, after both; read_sink() returns committed batches. So both sinks of a batch
appear together and each row once. ``trigger(availableNow=True)`` drains the backlog
and stops (the same job runs continuously with a processing-time trigger).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..operators import explain as EX
from ..operators import score as SC
from ..operators import validate as VA
from ..operators.linear import LinearScorer
from ..operators.train import ModelScorer
from ..operators.trees import TreeExplainer


@dataclass
class StreamPaths:
    source: str
    scored: str
    quarantine: str
    checkpoint: str

    @property
    def commits(self) -> str:
        return f"{self.checkpoint}/committed"


def scored_stream(records: DataFrame, scorer: LinearScorer | ModelScorer, explainer: EX.LinearExplainer | TreeExplainer | None,
                  high_value="single", top_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(scored rows with reasons, quarantined rows with errors) for a streaming or batch frame.

    ``high_value`` must be ``single`` or a fitted threshold on a stream: the batch
    mode needs a quantile over the whole frame, which an unbounded stream has not.
    """
    if records.isStreaming and high_value == "batch":
        raise ValueError("batch high-value mode needs the whole frame; use 'single' or a fitted threshold")
    valid, bad = VA.split_valid(records)
    return SC.score_records(valid, scorer, high_value, explainer, top_n), bad


def write_batch(batch: DataFrame, batch_id: int, paths: StreamPaths, scorer, explainer, high_value="single", top_n: int = 5) -> None:
    """Writes one micro-batch to both sinks, then its commit record. Running it again replaces what it wrote."""
    batch = batch.persist()  # read and parsed once for both sinks
    try:
        scored, bad = scored_stream(batch, scorer, explainer, high_value, top_n)
        for frame, out in ((scored, paths.scored), (bad, paths.quarantine)):
            frame.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    finally:
        batch.unpersist()
    done = batch.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("batch"))
    done.write.mode("overwrite").parquet(f"{paths.commits}/batch_id={batch_id}")


def read_sink(spark: SparkSession, paths: StreamPaths, sink: str) -> DataFrame:
    """Rows of the committed batches of the sink ``scored`` or ``quarantine``."""
    done = spark.read.parquet(paths.commits).select(F.col("batch").alias("batch_id")).distinct()
    rows = spark.read.parquet(getattr(paths, sink)).withColumn("batch_id", F.col("batch_id").cast("long"))
    return rows.join(done, "batch_id", "left_semi").drop("batch_id")


def start(spark: SparkSession, paths: StreamPaths, scorer: LinearScorer | ModelScorer,
          explainer: EX.LinearExplainer | TreeExplainer | None, schema=None, high_value="single", available_now: bool = True,
          processing_time: str = "10 seconds", files_per_batch: int | None = None) -> list[StreamingQuery]:
    """Start the one query that feeds the scored and the quarantine sink from the file source."""
    if high_value == "batch":
        raise ValueError("batch high-value mode needs the whole frame; use 'single' or a fitted threshold")
    reader = spark.readStream.schema(schema or S.raw_schema())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    w = (
        reader.parquet(paths.source)
        .writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, paths, scorer, explainer, high_value))
        .option("checkpointLocation", f"{paths.checkpoint}/progress")
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return [w.start()]


def run_to_completion(queries: list[StreamingQuery]) -> None:
    """Wait, without a limit, until every query has drained its input; a failed query raises and ends the others."""
    try:
        for q in queries:
            q.awaitTermination()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
