"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """df with a broadcast hint when it has at most max_rows rows, else as it is (a shuffled join).

    df should be cheap to read twice, such as a checkpointed aggregate.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
