"""Streaming application scoring (OP16 on a stream).

Scoring is a stateless per-row transform (``model.transform`` plus built-in
column expressions), so it runs unchanged on a streaming DataFrame: no
watermark or state store is needed. Progress and exactly-once file output
come from the checkpoint, kept under the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.classifier import score_loans
from ..session import checkpoint_dir

OUTPUT_COLUMNS = ["loan_id", "default_probability_pct", "risk_tier", "underwriting_recommendation"]


def read_applications(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming source of loan applications (explicit schema, as streams require)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def score_stream(model, applications: DataFrame) -> DataFrame:
    """Score each arriving application; works for batch and streaming inputs alike."""
    return score_loans(model, applications).select(*OUTPUT_COLUMNS)


def start_scoring(model, applications: DataFrame, sink_path: str, name: str = "loan_scoring",
                  available_now: bool = True) -> StreamingQuery:
    """Write scored applications to Parquet; the checkpoint lives in the shared folder."""
    spark = applications.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    writer = (score_stream(model, applications).writeStream.format("parquet")
              .option("path", sink_path).option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.queryName(name).start()
