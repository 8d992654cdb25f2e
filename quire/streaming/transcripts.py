"""Transcripts as a stream: rows (session, seq, op, command, output, ts) classified as they come, and sessions that stop at their first failure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions import commands as C


def classified(stream: DataFrame) -> DataFrame:
    """Adds the status of each output by itself: a projection, for streams and tables alike."""
    plain = F.when(C.command_error(F.col("command"), F.col("output")), F.lit("failed")).otherwise(F.lit("ok"))
    return stream.withColumn("status", F.when(F.col("op") == "config", plain).otherwise(C.output_status(F.col("command"), F.col("output"))))


def failures_by_window(stream: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Outputs and failures by window of event time; rows later than the watermark are left out."""
    t = classified(stream).withWatermark("ts", late)
    return t.groupBy(F.window("ts", window)).agg(F.count("*").alias("outputs"), F.count_if(F.col("status") != "ok").alias("failures")).select("window.start", "outputs", "failures")


def _stop(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values("seq")
    bad = rows["seq"][rows["status"] != "ok"]
    known = [int(state.get[0])] if state.exists else []
    failed = min([*known, *(int(x) for x in bad[:1])], default=None)
    if failed is not None:
        rows.loc[rows["seq"] > failed, "status"] = "skipped"
        state.update((failed,))
    state.setTimeoutDuration(24 * 3600 * 1000)
    yield pd.DataFrame({"session": key[0], "seq": rows["seq"], "status": rows["status"]})


def executed(stream: DataFrame) -> DataFrame:
    """Rows (session, seq, status) in which all that follows a session's first failure is skipped, over micro-batches; a session's state is one number and goes after a day without rows.

    Rows are told once: where a failure comes in a later batch than rows behind it, these stay as they were told, and only what comes after is skipped.
    """
    t = classified(stream).select("session", "seq", "status")
    return t.groupBy("session").applyInPandasWithState(_stop, "session string, seq int, status string", "failed int", "append", GroupStateTimeout.ProcessingTimeTimeout)
