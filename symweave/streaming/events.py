"""Structured Streaming over analyzer events: running counts, and the order of each request's events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symweave.operators.validate import PHASES

SCHEMA = "request_id STRING, ordinal BIGINT, type STRING, value STRING"


def event_files(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of events (SCHEMA) from JSON files as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def running_counts(events: DataFrame) -> DataFrame:
    """(request_id, type, n): the events of each kind so far, for complete or update mode."""
    return events.groupBy("request_id", "type").agg(F.count(F.lit(1)).alias("n"))


def order_problems(events: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """(request_id, ordinal, problem) of events out of order, as they arrive; one state of two numbers for each request.

    A request that stays silent for the idle time without having completed gives "no completion" and is forgotten.
    Events of one micro-batch are taken in order of their ordinal.
    """
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        request, rows = key[0], []
        phase, last = state.get if state.exists else (-1, -1)
        if state.hasTimedOut:
            if phase != PHASES["analysis_completed"]:
                rows.append((request, last, "no completion"))
            state.remove()
        else:
            for b in [pd.concat(list(batches)).sort_values("ordinal")]:
                for ordinal, kind in zip(b["ordinal"].tolist(), b["type"].tolist()):
                    now = PHASES.get(kind)
                    if now is None:
                        rows.append((request, ordinal, "unknown type"))
                    elif phase < 0 and now:
                        rows.append((request, ordinal, "no start"))
                    elif now < phase or now == phase and now in (0, 1, 6, 7):
                        rows.append((request, ordinal, "out of order"))
                    phase, last = max(phase, now or 0), ordinal
            state.update((phase, last))
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(rows, columns=["request_id", "ordinal", "problem"])

    return events.groupBy("request_id").applyInPandasWithState(
        follow, "request_id STRING, ordinal BIGINT, problem STRING", "phase INT, last BIGINT", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def write_tables(events: DataFrame, folder: str, checkpoint: str):
    """Starts the query that appends each micro-batch, parted by kind of event, to Parquet; restarts repeat no batch."""
    return events.writeStream.format("parquet").partitionBy("type").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
