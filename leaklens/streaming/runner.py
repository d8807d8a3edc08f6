"""Micro-batch running: the batch pipeline in foreachBatch, an audit sink, and windowed rates over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import preview
from ..operators import detect, diff, stats


def scan_batch(diffs: DataFrame) -> DataFrame:
    """Redacted findings of diffs (request_id, diff) with fixed-rule verdicts; the raw match does not leave."""
    lines = diff.added_lines(diff.diff_lines(diffs))
    found = detect.short_circuit(detect.dedup(detect.rule_findings(lines)))
    return found.select("request_id", "id", "path", "line", preview(F.col("match")).alias("match_preview"), F.coalesce("verdict", F.lit("undecided")).alias("verdict"))


def start_scan(spark: SparkSession, source: str, sink: str, checkpoint: str, max_files: int = 1000):
    """Scan diff files as they arrive. A batch is written under its id, so a repeated one replaces itself."""

    from ..sources.readers import read_diffs

    def write(batch: DataFrame, batch_id: int) -> None:
        scan_batch(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    arriving = spark.readStream.option("maxFilesPerTrigger", max_files).text(source, wholetext=True)
    named = arriving.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("request_id"), F.col("value").alias("diff"))
    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit(rows: DataFrame, path: str, reveal: bool = False) -> None:
    """Append one JSON line per row; a column ``match`` is written only on request."""
    (rows if reveal else rows.drop("match")).write.mode("append").json(path)


def event_rates(events: DataFrame, minutes: int = 5, watermark: str = "15 minutes") -> DataFrame:
    return stats.rates_by_window(events, "ts", F.col("event_type") == "purchase", minutes, watermark)
