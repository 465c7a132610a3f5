"""The aggregate that keeps the largest values of a group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def largest(value: Column, k: int) -> Column:
    """The ``k`` largest values of each group, the largest first, by a heap of that size before the shuffle and after it.

    Spark has this aggregate from 4.1 on, without a public name for it; where it lacks, all values of a group are sorted.
    """
    try:
        from pyspark.sql.internal import InternalFunction

        return InternalFunction._invoke_internal_function_over_columns("collect_top_k", value, F.lit(k), F.lit(False))
    except (ImportError, AttributeError):
        return F.slice(F.sort_array(F.collect_list(value), asc=False), 1, k)
