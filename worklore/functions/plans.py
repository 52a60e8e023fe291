"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def settle(df: DataFrame) -> DataFrame:
    """Compute the columns here, once per row.

    The optimizer moves later filters down by substituting column definitions,
    which would evaluate a long definition again for every filter that mentions
    it.  Filters stop above a generator, so the columns go through one.
    """
    return df.select(F.inline(F.array(F.struct("*"))))

