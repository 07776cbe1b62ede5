"""Joins against a key set whose size is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of fixed-width keys up to which a set is broadcast: 16 MB of longs.
BROADCAST_ROWS = 2_000_000


def small_or_shuffled(keys: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """keys, marked for broadcast if its counted rows stay within the bound; beyond it the join shuffles and AQE splits hot keys.

    keys must be cheap to read again, as a checkpoint is.
    """
    return F.broadcast(keys) if keys.count() <= bound else keys
