"""Extensions for ledgers that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def velocity(stream: DataFrame, least: int, window: str = "1 day", late: str = "1 day", time_col: str = "ts") -> DataFrame:
    """Windows of a statement with at least so many rows; rows later than `late` are left out."""
    counts = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), "statement_id").agg(F.count("*").alias("n_rows"))
    return counts.where(F.col("n_rows") >= least).select("statement_id", F.col("window.start").alias("start"), "n_rows")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day", time_col: str = "ts") -> DataFrame:
    """Runs of rows of a statement with no longer pause than gap."""
    runs = stream.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), "statement_id").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total"))
    return runs.select("statement_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_rows", "total")
