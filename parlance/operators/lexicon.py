"""Dictionaries (stop words, stems, clusters, gazetteers) as DataFrames and the joins against them.

Dictionaries are resources of a language, of thousands of rows. They are joined without a hint, so Spark
broadcasts them by their size and shuffles beyond its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text


def look_up(tokens: DataFrame, dictionary: DataFrame, on: Column | str, key: str, value: str, out: str, default: Column | None = None) -> DataFrame:
    """Left join with a dictionary of (key, value); `default` where it has none."""
    d = dictionary.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    on = F.col(on) if isinstance(on, str) else on
    found = F.col("__value") if default is None else F.coalesce("__value", default)
    return tokens.join(d, on == F.col("__key"), "left").withColumn(out, found).drop("__key", "__value")


def stem(tokens: DataFrame, stems: DataFrame, value: str = "value") -> DataFrame:
    """Column `stem`: the stem of the normalised token (stems: form, stem), or the normalised token itself."""
    norm = text.normalize(F.col(value))
    return look_up(tokens, stems, norm, "form", "stem", "stem", norm)


def forms_of_stems(stems: DataFrame) -> DataFrame:
    """stem and its sorted forms, joined by commas: the line format of stem files."""
    return stems.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set("form")), ",").alias("forms"))


def gate_rare(tokens: DataFrame, common: DataFrame, value: str = "value", word: str = "word") -> DataFrame:
    """Column `gated`: the normalised token if it is a common word, else rare_word."""
    norm = text.normalize(F.col(value))
    flagged = look_up(tokens, common.select(word).distinct().withColumn("yes", F.lit(True)), norm, word, "yes", "__common")
    return flagged.withColumn("gated", F.when(F.col("__common"), norm).otherwise("rare_word")).drop("__common")


def drop_stop_words(tokens: DataFrame, keys: list[str], stops: DataFrame) -> DataFrame:
    """keys and `kept`: the tokens that are no stop words, joined by a space, in lower case."""
    marked = look_up(tokens, stops.select("word").distinct().withColumn("yes", F.lit(True)), text.normalize(F.col("value")), "word", "yes", "__stop")
    held = F.array_sort(F.collect_list(F.when(F.col("__stop").isNull(), F.struct("i", "value"))))
    return marked.groupBy(*keys).agg(F.lower(F.array_join(F.transform(held, lambda x: x["value"]), " ")).alias("kept"))


def blank_stop_words(texts: DataFrame, keys: list[str], stops: DataFrame) -> DataFrame:
    """keys and `blanked`: the text with every stop word replaced by as many spaces, so offsets hold. texts: keys, text."""
    pieces = texts.select(*keys, F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"({text.PIECE})"), F.lit(1))).alias("pos", "value")).where("pos IS NOT NULL")
    marked = look_up(pieces, stops.select("word").distinct().withColumn("yes", F.lit(True)), text.normalize(F.col("value")), "word", "yes", "__stop")
    shown = marked.withColumn("v", F.when(F.col("__stop"), F.repeat(F.lit(" "), F.length("value"))).otherwise(F.col("value")))
    return shown.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]), "").alias("blanked"))


def whitelist(values: DataFrame, stops: DataFrame) -> DataFrame:
    """Stop words that are entity values of an intent themselves. values: intent, value; gives intent, word."""
    return values.select("intent", text.normalize(F.col("value")).alias("word")).join(stops.select("word"), "word", "left_semi").distinct().select("intent", "word")


def intent_stop_words(intents: DataFrame, stops: DataFrame, white: DataFrame) -> DataFrame:
    """Stop words of each intent: all but its whitelist. The number of intents and of stop words is a model's, not the data's."""
    listed = white.groupBy("intent").agg(F.collect_set("word").alias("white"))
    every = stops.agg(F.collect_set("word").alias("words")).withColumn("k", F.lit(1))
    out = intents.select("intent").distinct().withColumn("k", F.lit(1)).join(every, "k").join(listed, "intent", "left")
    left = F.array_except("words", F.coalesce("white", F.array().cast("array<string>")))
    return out.select("intent", F.explode(left).alias("word"))


def top_words(tokens: DataFrame, n: int) -> DataFrame:
    """rank (from 1) and word of the n most frequent normalised tokens; ties by word."""
    forms = tokens.groupBy("value").agg(F.count("*").alias("n"))  # so a form is normalised once, not at every place
    counted = forms.groupBy(text.normalize(F.col("value")).alias("word")).agg(F.sum("n").alias("count"))
    ranked = counted.orderBy(F.desc("count"), "word").limit(n)
    return ranked.select(F.row_number().over(W.orderBy(F.desc("count"), "word")).cast("long").alias("rank"), "word")
