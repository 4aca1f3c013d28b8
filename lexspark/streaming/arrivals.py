"""Structured Streaming over arriving judgements and answers. Nothing in the batch operators needs it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_deliveries(stream: DataFrame, id: str, at: str, late: str = "7 days") -> DataFrame:
    """Rows whose id was not delivered before within the watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([id])


def windowed_ratings(stream: DataFrame, at: str = "rated_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Per window and rater: number and mean of the ratings 0..3, final once the watermark passes."""
    rows = stream.filter(F.col("rating").between(0, 3)).withWatermark(at, late)
    return rows.groupBy(F.window(at, window).alias("w"), "rater_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean_rating")).select(F.col("w.start").alias("window_start"), "rater_id", "n", "mean_rating")


def running_switches(stream: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Per participant, over an unbounded stream of (participant_id, pos, sim): words so far, clusters so far and the
    size of the open cluster. State is three numbers per participant; rows of a batch are taken in order of pos."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, clusters, size = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("pos", kind="stable")
        for s in rows["sim"]:
            joins = n > 0 and pd.notna(s) and s >= threshold
            n, clusters, size = n + 1, clusters + (not joins), size + 1 if joins else 1
        state.update((int(n), int(clusters), int(size)))
        yield pd.DataFrame({"participant_id": [key[0]], "n_words": [n], "n_clusters": [clusters], "open_size": [size]})

    return stream.groupBy("participant_id").applyInPandasWithState(update, "participant_id string, n_words bigint, n_clusters bigint, open_size bigint", "n bigint, c bigint, s bigint", "update", GroupStateTimeout.NoTimeout)
