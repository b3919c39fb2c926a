"""Rules of datasets as relational checks, for utterances that come as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.operators.entities import is_builtin

ANNOTATION = r"\[([^:\]]+)(?::([^\]]+))?\](?:\(([^)]*)\))?"


def missing_entities(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, extensible, use_synonyms, strictness: the declared ones and, with defaults, those that only chunks name."""
    new = chunks.where(F.col("entity").isNotNull()).select("entity").distinct().join(entities, "entity", "left_anti")
    return entities.select("entity", "extensible", "use_synonyms", "strictness").unionByName(new.select("entity", F.lit(True).alias("extensible"), F.lit(True).alias("use_synonyms"), F.lit(1.0).alias("strictness")))


def violations(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """id, n, rule of every breach. chunks: id, n, text, slot_name, entity; entities: entity."""
    named = chunks.join(entities.select("entity").distinct().withColumn("declared", F.lit(True)), "entity", "left")
    rules = F.array_compact(
        F.array(
            F.when(F.col("text").isNull(), "no text"),
            F.when(F.col("slot_name").isNull() != F.col("entity").isNull(), "slot and entity must come together"),
            F.when(F.col("entity").isNotNull() & F.col("declared").isNull() & ~is_builtin(F.col("entity")), "entity is not declared"),
        )
    )
    return named.select("id", "n", F.explode(rules).alias("rule"))


def fill_implicit(chunks: DataFrame, values: DataFrame) -> DataFrame:
    """chunks (group, ord, entity, text) with null texts filled by the entity's values in turn. values: entity, k (from 0), m (their number), value.

    Turns are taken for each group and entity, in order of ord.
    """
    turn = F.row_number().over(W.partitionBy("group", "entity", F.col("text").isNull()).orderBy("ord")) - 1
    held = chunks.withColumn("turn", turn).join(values.select("entity", "m").distinct(), "entity", "left").withColumn("k", F.pmod("turn", "m"))
    filled = held.join(values.select("entity", "k", "value"), ["entity", "k"], "left")
    return filled.select("group", "ord", "entity", F.coalesce("text", "value").alias("text"))


def annotated_slots(text: Column) -> Column:
    """Slots of an annotated text as structs (slot_name, entity, value), in order; an entity that is not given is the slot's name."""
    marks = F.regexp_extract_all(text, F.lit(f"({ANNOTATION})"), F.lit(1))
    part = lambda m, i: F.nullif(F.regexp_extract(m, ANNOTATION, i), F.lit(""))
    return F.transform(marks, lambda m: F.struct(F.regexp_extract(m, ANNOTATION, 1).alias("slot_name"), F.coalesce(part(m, 2), F.regexp_extract(m, ANNOTATION, 1)).alias("entity"), part(m, 3).alias("value")))


def annotated_text(text: Column) -> Column:
    """The utterance without its marks; slots without value are empty."""
    return F.regexp_replace(text, ANNOTATION, "$3")
