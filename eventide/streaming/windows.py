"""Streaming forms of event operators: windowed counts, sessions, and islands kept as state. An extension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counts(events: DataFrame, ts: str, by: str, size: str, late: str) -> DataFrame:
    """Events in tumbling windows by a key; events later than `late` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    """Runs of events of a key that are never further apart than gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def islands(events: DataFrame, by: str, slack_us: int) -> DataFrame:
    """Merged intervals (by, begin_us, end_us) of intervals that come in order of their begin. An island is given out
    when an interval begins more than slack_us behind its end; the last one of each key stays in the state."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else None
        done = []
        rows = pd.concat(list(parts)).sort_values(["begin_us", "end_us"])
        for begin, end in zip(rows["begin_us"].tolist(), rows["end_us"].tolist(), strict=True):
            if open_ is None or begin > open_[1] + slack_us:
                done += [(key[0], *open_)] if open_ else []
                open_ = (begin, end)
            else:
                open_ = (min(open_[0], begin), max(open_[1], end))
        state.update(open_)
        yield pd.DataFrame(done, columns=[by, "begin_us", "end_us"])

    kind = events.schema[by].dataType.simpleString()
    return events.select(by, "begin_us", "end_us").groupBy(by).applyInPandasWithState(update, f"{by} {kind}, begin_us long, end_us long", "begin_us long, end_us long", "append", GroupStateTimeout.NoTimeout)
