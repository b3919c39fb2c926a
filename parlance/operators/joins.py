"""Joins of rows whose number Spark can't tell beforehand.

Spark takes exploded or grouped rows for about as large as the table that they come from. A text's n-grams are twenty times its rows, so it would broadcast millions of them
through the driver, where the table's size is under its threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a side that are sent to all tasks at most; beyond that both sides are shuffled.
FEW = 20_000
#: Different values of a dictionary or a model that are written into an expression at most.
LITERALS = 1_000


def by_key(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join whose sides are shuffled by their keys and sorted, so neither is held by the driver or by a task, and a key with very many rows is split."""
    return left.join(right.hint("merge"), on, how)


def with_few(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """A join of rows with a dictionary or a model, which are small as a rule: it goes to all tasks if it has few rows, as counted, else both sides are shuffled. rows: how many it has,
    if that is known."""
    few = (right.count() if rows is None else rows) <= FEW
    return left.join(right.hint("broadcast"), on, how) if few else by_key(left, right, on, how)


def few_values(df: DataFrame, column: str) -> list | None:
    """The different values of a column in order, if they are at most LITERALS, else None: no more rows than one above that reach the driver."""
    values = [r[0] for r in df.select(column).where(df[column].isNotNull()).distinct().limit(LITERALS + 1).collect()]
    return sorted(values) if len(values) <= LITERALS else None
