"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100_000


def sized(small: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has ``most`` rows at most, else as it is, so that the join is shuffled.

    The count stops at the bound. Rows are meant to be narrow: keys and numbers.
    """
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small
