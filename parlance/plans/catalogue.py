"""The named queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import joins, parsers
from parlance.plans import dataset_queries, engine_queries, entity_queries, feature_queries, gen, lexicon_queries, model_queries, parser_queries, registry, text_queries, variation_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated utterances parsed by lookup, each slot with its resolved value."""
    parsed = parser_queries.parsed(spark, sf_dir).select("id", "intent", "slot_name", F.col("kind").alias("entity"), "s", "e", F.col("value").alias("raw_value"))
    extensible = spark.sql("SELECT 'product' AS entity, true AS yes")
    resolved = parsers.resolve_slots(parsed.drop("intent"), gen.matches(spark, sf_dir), gen.entries(spark, sf_dir), extensible)
    return joins.by_key(parsed.select("id", "intent").distinct(), resolved, "id").select("id", "intent", "slot_name", "entity", "raw_value", "resolved")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
