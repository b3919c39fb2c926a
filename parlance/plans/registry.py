"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its own name; sql gives the same rows in DuckDB."""

    def add(function: Query) -> Query:
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


#: Shared fragments of the SQL twins.
TOKEN_SQL = r"[\p{L}\p{N}_]+|[$%!?&]"
PIECE_SQL = r"([\p{L}\p{N}_]+|[$%!?&]|[^\p{L}\p{N}_$%!?&]+)"


def tokens_sql(source: str, keys: str, text: str = "text") -> str:
    """CTEs `pieces` and `toks` (keys, i, value, s, e) over a source."""
    return f"""pieces AS (
  SELECT {keys}, unnest(regexp_extract_all({text}, '{PIECE_SQL}')) AS value, generate_subscripts(regexp_extract_all({text}, '{PIECE_SQL}'), 1) AS pos FROM {source}
), ends AS (
  SELECT *, sum(length(value)) OVER (PARTITION BY {keys} ORDER BY pos) AS e FROM pieces
), toks AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS i, value, (e - length(value))::BIGINT AS s, e::BIGINT AS e
  FROM ends WHERE regexp_matches(value, '^[\\p{{L}}\\p{{N}}_$%!?&]')
)"""


def normal_sql(text: str) -> str:
    return f"translate(lower({text}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
