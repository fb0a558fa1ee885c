"""Incremental forms over streams of new rows.

* point-in-time ingest: revisions arrive late and out of order; a watermark on
  the publication date drops what is later than allowed, and the state keeps
  the newest revision of each instrument and period
* trade_when as keyed state: the position of each instrument between batches
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def newest_revisions(revisions: DataFrame, late: str = "400 days") -> DataFrame:
    """sid, period_end, value, knowledge_ts, rev_seq: the newest revision so far (update mode)."""
    at = revisions.withColumn("at", F.col("knowledge_ts").cast("timestamp")).withWatermark("at", late)
    best = F.max(F.struct("at", "rev_seq", "value", "knowledge_ts")).alias("b")
    return at.groupBy("sid", "period_end").agg(best).select("sid", "period_end", F.col("b.value").alias("value"), F.col("b.knowledge_ts").alias("knowledge_ts"), F.col("b.rev_seq").alias("rev_seq"))


def trade_when_stream(signals: DataFrame) -> DataFrame:
    """sid, t, position of a stream of sid, t, condition, alpha, leave, with each instrument's position as state."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, known = state.get if state.exists else (0.0, False)
        for frame in frames:
            frame = frame.sort_values("t")
            out = []
            for c, a, e in zip(frame["condition"], frame["alpha"], frame["leave"], strict=True):
                if pd.notna(e) and e > 0:
                    known = False
                elif pd.notna(c) and c != 0:
                    held, known = (float(a), True) if pd.notna(a) else (0.0, False)
                out.append(held if known else None)
            yield pd.DataFrame({"sid": key[0], "t": frame["t"].to_numpy(), "position": pd.array(out, dtype="Float64")})
        state.update((held, known))

    return signals.groupBy("sid").applyInPandasWithState(run, "sid int, t int, position double", "held double, known boolean", "append", GroupStateTimeout.NoTimeout)
