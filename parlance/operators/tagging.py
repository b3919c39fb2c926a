"""Spans to tags and back, as windows over tokens: IO, BIO and BILOU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import joins
from parlance.operators.entities import scheme_prefix

SCHEMES = ("IO", "BIO", "BILOU")


def encode(tokens: DataFrame, spans: DataFrame, keys: list[str], scheme: str) -> DataFrame:
    """keys, i, tag, s, e of every token; O outside the spans. spans: keys, slot_name, s, e, without overlap."""
    ranged = spans.select(*keys, "slot_name", F.col("s").alias("span_s"), F.col("e").alias("span_e"))
    listed = ranged.groupBy(*keys).agg(F.collect_list(F.struct("span_s", "span_e", "slot_name")).alias("spans"))
    held = tokens.join(listed, keys, "left").withColumn("span", F.try_element_at(F.filter("spans", lambda x: (x["span_s"] <= F.col("s")) & (F.col("e") <= x["span_e"])), F.lit(1)))
    by = W.partitionBy(*keys, "span")
    place, size = F.row_number().over(by.orderBy("i")), F.count("*").over(by)
    tag = F.when(F.col("span").isNull(), "O").otherwise(F.concat(scheme_prefix(place, size, scheme), F.col("span.slot_name")))
    return held.select(*keys, "i", tag.alias("tag"), "s", "e")


def encoded(texts: DataFrame, spans: DataFrame, keys: list[str], scheme: str) -> DataFrame:
    """keys and tags, an array of i, tag, s, e of a text's tokens, as `encode` gives them as rows. texts: keys, text; spans: keys, slot_name, s, e, without overlap.

    A text meets its spans in one join and all else happens within its row, so no token is shuffled or sorted.
    """
    listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e", "slot_name"))).alias("__spans"))
    rows = joins.by_key(texts.select(*keys, "text"), listed, keys, "left").select(*keys, text.token_array(F.col("text")).alias("__toks"), "__spans")

    def held(x: Column) -> Column:
        inside = F.filter("__toks", lambda t: (x["s"] <= t["s"]) & (t["e"] <= x["e"]))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["slot_name"].alias("slot_name"), F.get(inside, F.lit(0))["i"].alias("first"), F.size(inside).alias("size"))

    def tag(t: Column, spans: Column) -> Column:
        def of(x: Column) -> Column:
            return F.when(x.isNull(), "O").otherwise(F.concat(scheme_prefix(t["i"] - x["first"] + 1, x["size"], scheme), x["slot_name"]))

        return text.bind(F.get(F.filter(spans, lambda x: (x["s"] <= t["s"]) & (t["e"] <= x["e"])), F.lit(0)), of)

    made = lambda spans: F.transform("__toks", lambda t: F.struct(t["i"].alias("i"), tag(t, spans).alias("tag"), t["s"].alias("s"), t["e"].alias("e")))
    return rows.select(*keys, text.bind(F.transform("__spans", held), made).alias("tags"))


def near(tags: Column, i: Column) -> Column:
    """The tag at a place of an array of them, O beyond its ends."""
    return F.coalesce(F.get(tags, i)["tag"], F.lit("O"))


def decoded(tags: Column, scheme: str) -> Column:
    """Structs slot_name, s, e of the slots in an array of tags, as `decode` gives them as rows."""

    def of(held: Column) -> Column:
        begins = F.filter(F.transform(held, lambda t, i: F.when(starts(t["tag"], near(held, i - 1), scheme), i)), lambda i: i.isNotNull())

        def slots(at: Column) -> Column:
            def one(b: Column, k: Column) -> Column:
                own = F.filter(F.slice(held, b + 1, F.coalesce(F.get(at, k + 1), F.size(held)) - b), lambda t: t["tag"] != "O")
                return text.bind(own, lambda own: F.struct(F.substring(F.element_at(own, -1)["tag"], 3, 1 << 30).alias("slot_name"), F.get(own, F.lit(0))["s"].alias("s"), F.element_at(own, -1)["e"].alias("e")))

            return F.transform(at, one)

        return text.bind(begins, slots)

    return text.bind(tags, of)


def starts(tag: Column, before: Column, scheme: str) -> Column:
    """Whether a slot begins at a token. before: the tag of the token before, O at the start."""
    inside = tag != "O"
    if scheme == "IO":
        return inside & (before == "O")
    if scheme == "BIO":
        return inside & (tag.startswith("B-") | (before == "O"))
    if scheme == "BILOU":
        return inside & (tag.startswith("B-") | tag.startswith("U-") | before.startswith("U-") | before.startswith("L-") | (before == "O"))
    raise ValueError(f"unknown tagging scheme {scheme!r}")


def ends(tag: Column, after: Column, scheme: str) -> Column:
    """Whether a slot ends at a token: the next one, O at the end, is outside or begins another."""
    inside = tag != "O"
    if scheme == "IO":
        return inside & (after == "O")
    if scheme == "BIO":
        return inside & ((after == "O") | after.startswith("B-"))
    if scheme == "BILOU":
        return inside & ((after == "O") | after.startswith("B-") | after.startswith("U-") | tag.startswith("L-") | tag.startswith("U-"))
    raise ValueError(f"unknown tagging scheme {scheme!r}")


def decode(tags: DataFrame, keys: list[str], scheme: str) -> DataFrame:
    """keys, slot_name, s, e: gaps and islands over the tags; a span has the name of its last tag."""
    by = W.partitionBy(*keys).orderBy("i")
    before = F.coalesce(F.lag("tag").over(by), F.lit("O"))
    begun = tags.withColumn("begins", starts(F.col("tag"), before, scheme).cast("int"))
    numbered = begun.withColumn("island", F.sum("begins").over(by)).where("tag <> 'O'")
    return numbered.groupBy(*keys, "island").agg(F.expr("substring(max_by(tag, i), 3)").alias("slot_name"), F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def keyword_slots(tokens: DataFrame, keywords: DataFrame, keys: list[str], lowercase: bool = False, on: list[str] | None = None) -> DataFrame:
    """keys, s, e, value, entity, slot_name of tokens that are keywords. keywords: keyword, entity, slot_name, ord; the last one wins.

    on: further columns, such as the intent, in which tokens and keywords must agree.
    """
    on = on or []
    last = keywords.groupBy("keyword", *on).agg(F.max_by("entity", "ord").alias("entity"), F.max_by("slot_name", "ord").alias("slot_name"))
    word = F.lower("value") if lowercase else F.col("value")
    return tokens.withColumn("keyword", word).join(last, ["keyword", *on]).select(*keys, "s", "e", "value", "entity", "slot_name")
