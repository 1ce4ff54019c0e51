"""Joins of the facts to a dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerscope.functions.money import total


def rollup_through(
    facts: DataFrame,
    key: str,
    fact_columns: Mapping[str, Column],
    dimension: DataFrame,
    by: Sequence[str | Column],
    amounts: Mapping[str, str],
    counts: Mapping[str, Column],
) -> DataFrame:
    """Sums per ``by``, whose columns come from the facts and, through ``key``, the dimension.

    ``amounts`` (output name to fact column) are summed exactly, ``counts`` (output name to
    a whole-number expression) as integers. The facts are summed per key and fact column
    before the join, at every size: Spark sums inside each input split first, so a hot key
    arrives as few rows. How the sums meet the dimension is left to adaptive execution,
    which knows the bytes of both.
    """
    rows = facts.select(
        key,
        *(column.alias(name) for name, column in fact_columns.items()),
        *(F.col(source).alias(name) for name, source in amounts.items()),
        *(column.alias(name) for name, column in counts.items()),
    )
    sums = [*(total(name).alias(name) for name in amounts), *(F.sum(name).alias(name) for name in counts)]
    summed = rows.groupBy(key, *fact_columns).agg(*sums)
    return summed.join(dimension, key).groupBy(*by).agg(*sums)
