"""Intent parsers as joins: lookup by key, patterns, cascades, rankings and slot resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import entities, joins

GAP = r"[^\p{L}\p{N}_$%!?&]*"


def lookup_key(rewritten: Column) -> Column:
    """Tokens of a text with placeholders, in lower case, joined by a space."""
    return F.lower(F.array_join(text.tokenize_light(rewritten), " "))


def training_keys(texts: DataFrame, slots: DataFrame) -> DataFrame:
    """id, rewritten: annotated utterances with a placeholder for each slot. texts: id, text; slots: id, entity, s, e."""
    marked = slots.select("id", F.col("entity").alias("kind"), "s", "e", F.lit("").alias("value"))
    return entities.replace_with_placeholders(texts, marked, ["id"])[0]


def parts_of(rewritten: Column) -> Column:
    """Tokens of a text with placeholders, which stay whole, in lower case."""
    return F.transform(F.regexp_extract_all(rewritten, F.lit(f"({text.MARK}|{text.TOKEN})"), F.lit(1)), F.lower)


def without_stops(parts: Column, stops: Column | None) -> Column:
    return parts if stops is None else F.filter(parts, lambda p: ~F.array_contains(stops, text.normalize(p)))


def _named(slots: DataFrame) -> DataFrame:
    """id, slot_names in the order of the slots."""
    return slots.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "slot_name"))), lambda x: x["slot_name"]).alias("slot_names"))


def build_lookup(trained: DataFrame, slots: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """key, intent, slot_names (in order), n_slots, parts, stops. trained: id, intent, rewritten; stops: intent, words, which its keys go without.

    A key with two different outputs is left out.
    """
    rows = joins.by_key(trained, _named(slots), "id", "left")
    rows = rows.withColumn("stops", F.array().cast("array<string>")) if stops is None else rows.join(stops.withColumnRenamed("words", "stops"), "intent", "left")
    parts = without_stops(parts_of(F.col("rewritten")), F.coalesce("stops", F.array().cast("array<string>")))
    whole = lookup_key(F.col("rewritten")) if stops is None else F.array_join(parts, " ")
    rows = rows.select(whole.alias("key"), "intent", F.coalesce("slot_names", F.array().cast("array<string>")).alias("slot_names"), parts.alias("parts"), F.coalesce("stops", F.array().cast("array<string>")).alias("stops"))
    each = rows.groupBy("key", "intent", "slot_names").agg(F.min("parts").alias("parts"), F.first("stops").alias("stops"))
    alone = each.groupBy("key").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("intent", "slot_names", "parts", "stops")])
    return alone.where("n = 1").select("key", "intent", "slot_names", F.size("slot_names").cast("long").alias("n_slots"), "parts", "stops")


def indexed(models: DataFrame) -> DataFrame:
    """models (with parts) and filed: the one of its parts that the fewest models have, which every text that it fits must offer."""
    own = models.withColumn("__m", F.xxhash64("intent", F.concat_ws(" ", "parts"), F.concat_ws(" ", "slot_names")))
    each = own.select("__m", F.explode(F.array_distinct("parts")).alias("part"))
    least = each.join(each.groupBy("part").agg(F.count("*").alias("n")), "part").groupBy("__m").agg(F.min(F.struct(F.col("part").startswith("%") & (F.length("part") > 1), "n", "part")).alias("x"))
    return own.join(least.select("__m", F.col("x.part").alias("filed")), "__m", "left").withColumn("filed", F.coalesce("filed", F.lit(""))).drop("__m")


def find(texts: DataFrame, matches: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of models whose parts a text has when some of its entities, any subset of them that does not overlap, are read as
    their placeholders: keys, the models' columns but parts, stops and filed, and found (n, kind, s, e, value, of) of the entities taken.

    texts: keys, text; matches: keys, kind, s, e, value, which may overlap; models: `indexed`. A text meets only the
    models that are filed under a token or a placeholder that it offers. Whether it fits is found by walking
    through the model's parts from each place that the parts before can end at, so no subset is tried by itself and their number does not matter.
    Words of the model's intent's stops are skipped. Of several entities that lead to the same place the longest wins.
    """
    listed = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind", "value"))).alias("held"))
    rows = joins.by_key(texts.select(*keys, "text"), listed, keys, "left")
    toks = F.transform(text.token_array(F.col("text")), lambda t: F.struct(F.lower(t["value"]).alias("w"), t["s"].alias("s"), t["e"].alias("e")))
    rows = rows.select(*keys, "held", toks.alias("toks"))

    def spot(starts: Column, stops: Column, m: Column, n: Column) -> Column:
        first, end = F.array_position(starts, m["s"]) - 1, F.array_position(stops, m["e"])
        return F.struct(first.cast("int").alias("at"), end.cast("int").alias("to"), F.lower(text.placeholder(m["kind"])).alias("label"), m["kind"].alias("kind"), m["s"].alias("s"), m["e"].alias("e"), m["value"].alias("value"), n.alias("of"))

    held = F.coalesce("held", F.array().cast("array<struct<s:bigint,e:bigint,kind:string,value:string>>"))
    places = F.struct(F.transform("toks", lambda t: t["s"]).alias("s"), F.transform("toks", lambda t: t["e"]).alias("e"))
    spots = text.bind(places, lambda p: F.filter(F.transform(held, lambda m, n: spot(p["s"], p["e"], m, n)), lambda x: (x["at"] >= 0) & (x["to"] > x["at"])))
    rows = rows.select(*keys, "toks", F.reverse(F.array_sort(spots)).alias("spots"))
    offered = F.array_distinct(F.concat(F.transform("toks", lambda t: t["w"]), F.transform("spots", lambda x: x["label"]), F.array(F.lit(""))))
    filed = joins.few_values(models, "filed")
    if filed is not None:  # a row for each place where a model may be filed, not for each token
        offered = F.filter(offered, lambda o: o.isin(*filed)) if filed else F.filter(offered, lambda o: F.lit(False))
    tried = joins.with_few(text.each(rows, [*keys, "toks", "spots"], offered, "filed"), models, "filed")

    n = F.size("toks")

    def skipped(at: Column) -> Column:
        """Where a walk stands after the stop words from a place on."""
        rest = F.when(at < n, F.sequence(at, n - 1)).otherwise(F.array().cast("array<int>"))
        stay = F.filter(rest, lambda i: ~F.array_contains("stops", text.normalize(F.get("toks", i)["w"])))
        return F.when(F.size("stops") == 0, at).otherwise(F.coalesce(F.get(stay, 0), n))

    def step(places: Column, part: Column) -> Column:
        def onward(x: Column) -> Column:
            def between(stop: Column) -> Column:
                word = F.when(F.get("toks", stop)["w"] == part, F.struct((stop + 1).alias("at"), x["path"].alias("path")))
                taken = F.filter("spots", lambda y: (y["at"] >= x["at"]) & (y["at"] <= stop) & (y["label"] == part))
                return F.concat(F.transform(taken, lambda y: F.struct(y["to"].alias("at"), F.array_append(x["path"], y).alias("path"))), F.array_compact(F.array(word)))

            return text.bind(skipped(x["at"]), between)

        once = lambda made: F.when(F.size(made) > 1, F.filter(made, lambda y, i: F.array_position(F.transform(made, lambda z: z["at"]), y["at"]) == i + 1)).otherwise(made)
        return text.bind(F.flatten(F.transform(places, onward)), once)

    begin = F.array(F.struct(F.lit(0).alias("at"), F.filter("spots", lambda x: F.lit(False)).alias("path")))
    ends = F.filter(F.aggregate("parts", begin, step), lambda x: skipped(x["at"]) == n)
    found = F.transform(F.col("done")["path"], lambda x, i: F.struct(i.cast("long").alias("n"), *[x[c].alias(c) for c in ("kind", "s", "e", "value", "of")]))
    columns = [c for c in models.columns if c not in ("parts", "stops", "filed")]
    # exploded, so that the walk is not made a second time for a filter of rows whose walk ends
    return text.each(tried, [*keys, *columns], F.slice(ends, 1, 1), "done").select(*keys, *columns, found.alias("found"))


def slot_rows(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, intent, n, slot_name, kind, s, e, value of the hits of `find`: a row for each slot (one with nulls where an intent has none)."""
    slots = F.transform("found", lambda r, i: F.struct(r["n"].alias("n"), F.get("slot_names", i).alias("slot_name"), r["kind"].alias("kind"), r["s"].alias("s"), r["e"].alias("e"), r["value"].alias("value")))
    return hits.select(*keys, "intent", F.explode_outer(slots).alias("slot")).select(*keys, "intent", "slot.*")


def first_of_intent(hits: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One hit for each intent of a text: the first in that order."""
    ranked = hits.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "intent").orderBy(*order)))
    return ranked.where("__r = 1").drop("__r")


def lookup_parse(texts: DataFrame, matches: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """The lookup table's hits (see `find`), for each intent the one with the fewest slots, then the first entities: keys, intent, n_slots, slot_names, found."""
    hits = find(texts, matches, indexed(lookup.drop("key")), keys)
    return first_of_intent(hits, keys, "n_slots", F.reverse(F.transform("found", lambda x: x["of"])))


def mask(found: Column) -> Column:
    """The entities taken as bits, by their place among all of the text's; for at most 126 of them."""
    return F.aggregate(found, F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + F.pow(F.lit(2.0), x["of"])).cast("decimal(38,0)"))


def build_patterns(trained: DataFrame, slots: DataFrame, max_queries: int = 100, max_length: int = 1000, stops: DataFrame | None = None) -> DataFrame:
    """intent, ord (from 0), pattern, slot_names, n_slots, parts, stops. trained: id, intent, rewritten; stops: intent, words, which its patterns go without.

    A pattern that several intents have serves none; those too long go, and of the rest an intent keeps the first by id.
    """
    none = F.array().cast("array<string>")
    rows = joins.by_key(trained, _named(slots), "id", "left")
    rows = rows.withColumn("stops", none) if stops is None else rows.join(stops.withColumnRenamed("words", "stops"), "intent", "left").withColumn("stops", F.coalesce("stops", none))
    kept = lambda c: without_stops(c, F.col("stops"))
    cut = kept(F.regexp_extract_all("rewritten", F.lit(f"({text.MARK}|{text.TOKEN})"), F.lit(1)))
    shown = F.transform(cut, lambda t: F.when(t.rlike(f"^{text.MARK}$"), F.concat(F.lit("("), t, F.lit(")"))).otherwise(text.regex_escape(F.lower(t))))
    pattern = F.concat(F.lit("^" + GAP), F.array_join(shown, GAP), F.lit(GAP + "$"))
    rows = rows.select("id", "intent", pattern.alias("pattern"), F.coalesce("slot_names", none).alias("slot_names"), kept(parts_of(F.col("rewritten"))).alias("parts"), "stops")
    first = F.min(F.struct("id", "slot_names", "parts", "stops")).alias("x")
    each = rows.groupBy("intent", "pattern").agg(first).select("intent", "pattern", "x.*")
    single = each.join(each.groupBy("pattern").agg(F.count("*").alias("n")).where("n = 1"), "pattern").where(F.length("pattern") < max_length)
    ranked = single.withColumn("ord", (F.row_number().over(W.partitionBy("intent").orderBy("id", "pattern")) - 1).cast("long"))
    return ranked.where(F.col("ord") < max_queries).select("intent", "ord", "pattern", "slot_names", F.size("slot_names").cast("long").alias("n_slots"), "parts", "stops")


def pattern_parse(texts: DataFrame, matches: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """The patterns' hits (see `find`), for each intent its first pattern: keys, intent, ord, n_slots, slot_names, found.

    A pattern is its parts with anything but tokens between them; it is filed under its rarest part, so no text meets all of them and
    no regular expression is compiled for a row.
    """
    return first_of_intent(find(texts, matches, indexed(patterns.drop("pattern")), keys), keys, "ord")


def reweight(candidates: DataFrame, top_n: int | None = None) -> DataFrame:
    """id, intent, probability: 1 / (1 + slots), normalised over the candidates of an utterance; the top n by probability, then intent."""
    weighed = candidates.withColumn("w", 1 / (1 + F.col("n_slots")))
    out = weighed.select("id", "intent", (F.col("w") / F.sum("w").over(W.partitionBy("id"))).alias("probability"))
    if top_n is None:
        return out
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    ranked = out.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("probability"), "intent")))
    return ranked.where(F.col("r") <= top_n).drop("r")


def cascade(ids: DataFrame, *stages: DataFrame) -> DataFrame:
    """id, intent, probability, stage: the first stage that has an intent decides; none: null intent, probability 1, null stage. Every stage is made once."""
    numbered = [s.where(F.col("intent").isNotNull()).select("id", "intent", "probability", F.lit(k).cast("long").alias("stage")) for k, s in enumerate(stages)]
    none = F.array(F.struct(F.lit(None).cast("string").alias("intent"), F.lit(1.0).alias("probability"), F.lit(None).cast("long").alias("stage")))
    if not numbered:
        return ids.select("id", F.inline(none))
    every = reduce(DataFrame.unionByName, numbered).groupBy("id").agg(F.collect_list(F.struct("intent", "probability", "stage")).alias("all"), F.min("stage").alias("first"))
    first = every.select("id", F.filter("all", lambda x: x["stage"] == F.col("first")).alias("kept"))
    return joins.by_key(ids.select("id"), first, "id", "left").select("id", F.inline(F.coalesce("kept", none)))


def merge_scores(ids: DataFrame, intents: DataFrame, *scored: DataFrame) -> DataFrame:
    """id, intent, probability of every intent: the best over the parsers, 0 where none has it. intents: a model's few rows."""
    best = reduce(DataFrame.unionByName, [s.select("id", "intent", "probability") for s in scored]).groupBy("id", "intent").agg(F.max("probability").alias("probability"))
    by_id = best.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("intent", "probability"))).alias("known"))
    listed = intents.agg(F.array_sort(F.collect_set("intent")).alias("intents"))  # one row
    every = joins.by_key(ids.select("id"), by_id, "id", "left").join(F.broadcast(listed)).select("id", "known", F.explode("intents").alias("intent"))
    return every.select("id", "intent", F.coalesce(F.try_element_at("known", F.col("intent")), F.lit(0.0)).alias("probability"))


def resolve_slots(slots: DataFrame, matches: DataFrame, entries: DataFrame, extensible: DataFrame) -> DataFrame:
    """slots (id, slot_name, entity, s, e, raw_value; other columns stay) with `resolved`.

    By the match of that entity at that range, else by the dictionary entry equal to the normalised raw value, else the raw value
    itself where the entity is extensible (extensible: entity, yes); a slot that nothing resolves is dropped.
    """
    exact = matches.groupBy("id", F.col("kind").alias("entity"), "s", "e").agg(F.min("resolved").alias("exact"))
    again = entries.select(F.col("kind").alias("entity"), F.col("norm"), F.col("resolved").alias("again"))
    norm = F.array_join(text.tokenize_light(text.normalize(F.col("raw_value"))), " ")
    known = joins.by_key(slots, exact, ["id", "entity", "s", "e"], "left").withColumn("norm", norm)
    found = joins.with_few(known, again, ["entity", "norm"], "left").join(extensible.select("entity", "yes"), "entity", "left")
    out = found.withColumn("resolved", F.coalesce("exact", "again", F.when(F.col("yes"), F.col("raw_value"))))
    return out.where(F.col("resolved").isNotNull()).select("id", *[c for c in slots.columns if c not in ("id", "slot_name", "entity", "s", "e", "raw_value")], "slot_name", "entity", "s", "e", "raw_value", "resolved")


def entity_scopes(intent_entities: DataFrame) -> DataFrame:
    """entities (sorted) and the intents that use exactly those. intent_entities: intent, entity."""
    own = intent_entities.groupBy("intent").agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("entities"))
    return own.groupBy("entities").agg(F.array_join(F.array_sort(F.collect_set("intent")), ",").alias("intents"))


def parsing_result(parsed: DataFrame) -> DataFrame:
    """id, result: {intent: {intentName, probability}, slots: [{range, rawValue, entity, slotName}]} as JSON. parsed: the rows of lookup_parse."""
    slot = F.when(F.col("slot_name").isNotNull(), F.struct("n", F.struct(F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias("range"), F.col("value").alias("rawValue"), F.col("kind").alias("entity"), F.col("slot_name").alias("slotName")).alias("slot")))
    rows = parsed.groupBy("id", "intent").agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    return rows.select("id", F.to_json(F.struct(F.struct(F.col("intent").alias("intentName"), F.lit(1.0).alias("probability")).alias("intent"), F.transform("slots", lambda x: x["slot"]).alias("slots"))).alias("result"))
