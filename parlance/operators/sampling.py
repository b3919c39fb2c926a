"""Augmentation, noise and folds, drawn from MD5 so that they repeat at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators.ordering import numbered

UNKNOWN = "unknownword"


def draw(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from a seed and a key."""
    return F.conv(F.substring(order(seed, *key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def order(seed: int, *key: Column) -> Column:
    """An order key that shuffles by a seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def shuffled(values: DataFrame, group: list[str], value: str, seed: int) -> DataFrame:
    """group, value, k (from 0, shuffled by the seed) and n, the size of the group."""
    by = W.partitionBy(*(group or [F.lit(0)]))
    return values.select(*group, value, (F.row_number().over(by.orderBy(order(seed, F.col(value)), value)) - 1).cast("long").alias("k"), F.count("*").over(by).alias("n"))


def augment(templates: DataFrame, values: DataFrame, n: int, seed: int) -> DataFrame:
    """intent, i, generated for 0 <= i < n: shuffled templates and shuffled values of the placeholder, both cyclic.

    templates: intent, template; values: mark, value. The marks of a template are replaced by value i of each.
    """
    t = shuffled(templates.distinct(), ["intent"], "template", seed)
    sizes = t.select("intent", "n").distinct()
    rows = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    filled = rows.withColumn("k", F.pmod("i", "n")).join(t.drop("n"), ["intent", "k"]).select("intent", "i", F.col("template").alias("generated"))
    v = shuffled(values.distinct(), ["mark"], "value", seed)
    marks = v.select("mark", F.col("n").alias("m")).distinct()
    used = filled.withColumn("mark", F.explode(F.array_distinct(F.regexp_extract_all("generated", F.lit("(%[A-Z]+%)"), F.lit(1))))).join(marks, "mark")
    picked = used.withColumn("k", F.pmod("i", "m")).join(v.drop("n"), ["mark", "k"])
    held = picked.groupBy("intent", "i").agg(F.array_sort(F.collect_list(F.struct("mark", "value"))).alias("parts"))
    out = filled.join(held, ["intent", "i"], "left")
    put = F.aggregate(F.coalesce("parts", F.array().cast("array<struct<mark:string,value:string>>")), F.col("generated"), lambda acc, p: F.replace(acc, p["mark"], p["value"]))
    return out.select("intent", "i", put.alias("generated"))


def capitalise(values: DataFrame, key: str, value: str, ratio: float, seed: int) -> DataFrame:
    """key, spoken: title case where the draw is within the ratio, else lower case."""
    return values.select(key, F.when(draw(seed, F.col(key)) <= ratio, text.title(F.lower(value))).otherwise(F.lower(value)).alias("spoken"))


def noise(ids: DataFrame, words: DataFrame, mean: float, spread: float, seed: int) -> DataFrame:
    """i, noise: cyclic noise words; how many is drawn about the mean (Box-Muller, at least one). words: ord (from 0), word; ids: i (long)."""
    u, v = 1 - draw(seed, F.col("i")), draw(seed + 1, F.col("i"))
    size = F.greatest(F.lit(1), F.floor(F.lit(mean) + F.lit(spread) * F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v))).cast("int")
    listed = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]).alias("words")).withColumn("one", F.lit(1))
    each = ids.select("i", size.alias("size")).withColumn("one", F.lit(1)).join(F.broadcast(listed), "one")
    pick = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.element_at("words", (F.pmod(F.col("i") * 7 + j, F.size("words")) + 1).cast("int")))
    return each.select("i", F.array_join(pick, " ").alias("noise"))


def replace_unknown(tokens: DataFrame, vocabulary: DataFrame, keys: list[str], replacement: str = UNKNOWN) -> DataFrame:
    """keys, smart: the normalised tokens joined, words outside the vocabulary (word) replaced; runs of the replacement collapse."""
    norm = tokens.withColumn("word", text.normalize(F.col("value")))
    known = norm.join(vocabulary.select("word").distinct().withColumn("yes", F.lit(True)), "word", "left")
    held = F.array_sort(F.collect_list(F.struct("i", F.when(F.col("yes"), F.col("word")).otherwise(replacement).alias("w"))))
    joined = known.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["w"]), " ").alias("smart"))
    return joined.withColumn("smart", F.regexp_replace("smart", f"\\b{replacement}( {replacement})+\\b", replacement))


def add_unknown(utterances: DataFrame, key: Column, text_col: str, chance: float, most: int, seed: int, replacement: str = UNKNOWN) -> DataFrame:
    """The rows with, by chance, one to `most` replacement words behind the text."""
    times = (1 + F.floor(draw(seed + 1, key) * most)).cast("int")
    tail = F.repeat(F.lit(" " + replacement), times)
    return utterances.withColumn(text_col, F.when(draw(seed, key) < chance, F.concat(text_col, tail)).otherwise(F.col(text_col)))


def folds(rows: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """key, label, fold: stratified by label, in turn by a seeded order. The order is that of digests, so its first digits deal it to many tasks
    however few the labels are."""
    held = rows.select(key, label, order(seed, F.col(key)).alias("__order"))
    made = numbered(held, F.substring("__order", 1, 3), ["__order", key], [label], "__n")
    return made.select(key, label, F.pmod("__n", F.lit(k)).cast("long").alias("fold"))
