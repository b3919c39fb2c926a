"""Parsing of streams: each micro-batch goes through the same transformation as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.operators import entities
from parlance.plans.engine import IntentEngineModel
from parlance.plans.units import find_entities


def parse_stream(texts: DataFrame, model: IntentEngineModel, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the results of a streaming DataFrame (id, text) to Parquet at path.

    The parsers aggregate by utterance and ask each other in turn, which a streaming plan doesn't allow without a watermark, so batches are parsed in foreachBatch. A batch that
    is run again after a failure overwrites its own folder, so results are written once.
    """

    def one(batch: DataFrame, number: int) -> None:
        model.parse(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        model.release()

    writer = texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def entity_stream(texts: DataFrame, model: IntentEngineModel) -> DataFrame:
    """id, kind, s, e, value, resolved of the entities in a streaming DataFrame (id, text), as a streaming DataFrame: tokens, grammars and
    n-grams are made within the row, and the dictionary is a static table. Entities of a strictness below one match by runs of their values' words, without gaps: what has
    gaps is found by grouping a text's words, which a stream would keep state for."""
    _, kinds, language, loose = model.prepare_lengths()
    strict = model.spark.createDataFrame(list(loose.items()), "kind string, strictness double")
    known = entities.with_parts(model.tables["entries"], strict) if loose else model.tables["entries"]
    return find_entities(texts.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")), known, entities.entry_lengths(known), kinds, language)
