"""Surface variations of entity values, and the expansion of values into surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import spoken, text

#: At most so many variations by one rule; a value that would have more gets none of them.
LIMIT = 10
#: The word for "and" of the languages that have the rule.
AND = {"en": "and", "fr": "et", "es": "y", "de": "und"}


def _product(pieces: Column, marked, other) -> Column:
    """Strings made of pieces where each marked piece is itself or `other` of it, capped at LIMIT combinations."""
    order = F.transform(pieces, lambda p, k: F.struct(p.alias("p"), F.size(F.filter(F.slice(pieces, 1, k), marked)).alias("b"), marked(p).alias("m")))
    n = F.size(F.filter(pieces, marked))
    masks = F.when((n > 0) & (F.pow(F.lit(2), n) <= LIMIT), F.sequence(F.lit(0), F.pow(F.lit(2), n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        masks,
        lambda mask: F.array_join(
            F.transform(order, lambda o: F.when(o["m"] & ((F.floor(mask / F.pow(F.lit(2), o["b"])) % 2) == 1), other(o["p"])).otherwise(o["p"])), ""
        ),
    )


def punctuation_variations(value: Column) -> Column:
    """Each punctuation mark kept or dropped."""
    pieces = F.regexp_extract_all(value, F.lit(r"([!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~]+)"), F.lit(1))
    return _product(pieces, lambda p: p.rlike(r"^[!-/:-@\[-`{-~]$"), lambda p: F.lit(""))


def and_variations(value: Column, lang: str = "en") -> Column:
    """Each `and` between spaces kept or written &."""
    word = AND.get(lang)
    if word is None:
        return F.array().cast("array<string>")
    pieces = F.regexp_extract_all(value, F.lit(f"(?s)( {word}(?= )| &(?= )|.(?:(?! {word} | & ).)*)"), F.lit(1))
    return _product(pieces, lambda p: p.isin(f" {word}", " &"), lambda p: F.when(p == f" {word}", " &").otherwise(f" {word}"))


def number_variations(value: Column, lang: str = "en") -> Column:
    """Each whole number of up to four digits in digits or in words of a language; none in languages without number words."""
    if lang not in spoken.LANGUAGES:
        return F.array().cast("array<string>")
    pieces = F.regexp_extract_all(value, F.lit(r"((?<![0-9])[0-9]{1,4}(?![0-9])|[0-9]+|[^0-9]+)"), F.lit(1))
    return _product(pieces, lambda p: p.rlike("^[0-9]{1,4}$"), lambda p: spoken.spell(p.cast("int"), lang))


def case_variations(value: Column) -> Column:
    return F.array(F.lower(value), text.title(value))


def string_variations(value: Column, lang: str = "en") -> Column:
    """All rules in turn, each applied to what the ones before gave; single spaces at the end. Distinct and sorted."""
    flat = lambda a, rule: F.array_distinct(F.concat(a, F.flatten(F.transform(a, rule))))
    out = F.array(value)
    out = flat(out, case_variations)
    out = flat(out, lambda v: F.array(text.normalize(v)))
    out = flat(out, lambda v: and_variations(v, lang))
    out = flat(out, punctuation_variations)
    out = flat(out, lambda v: number_variations(v, lang))
    tidy = F.transform(out, lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.concat(tidy, F.transform(tidy, lambda v: F.array_join(text.tokenize_light(v), " ")))))


def synonym_surfaces(values: DataFrame) -> DataFrame:
    """entity, surface, resolved of values and synonyms. values: entity, ord, value, synonyms.

    A value stands for itself whatever comes before; a synonym that several values have stands for the first of them.
    """
    own = values.select("entity", "ord", F.lit(0).alias("rank"), F.col("value").alias("surface"), F.col("value").alias("resolved"))
    other = values.select("entity", "ord", F.lit(1).alias("rank"), F.explode("synonyms").alias("surface"), F.col("value").alias("resolved"))
    first = W.partitionBy("entity", "surface").orderBy("rank", "ord", "resolved")
    return own.unionByName(other).withColumn("n", F.row_number().over(first)).where("n = 1").select("entity", "surface", "resolved")


def expand_surfaces(surfaces: DataFrame, lang: str = "en") -> DataFrame:
    """entity, surface, resolved with variations added: those that belong to one resolved value alone and equal no original."""
    made = surfaces.select("entity", F.explode_outer(string_variations(F.col("surface"), lang)).alias("surface"), "resolved").where("surface IS NOT NULL").distinct()
    alone = made.groupBy("entity", "surface").agg(F.count("*").alias("n"), F.min("resolved").alias("resolved")).where("n = 1 AND surface <> ''")
    new = alone.join(surfaces.select("entity", "surface"), ["entity", "surface"], "left_anti").select("entity", "surface", "resolved")
    return surfaces.unionByName(new)
