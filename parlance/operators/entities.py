"""Entity extraction as joins and windows over tokens: builtin grammars, gazetteers, overlap removal, placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import calendar, grammar, joins, lexicon, ordering

#: The kinds of builtin entities and, of those, the ones that a dictionary holds.
GRAMMAR_KINDS = ("amountOfMoney", "duration", "number", "ordinal", "temperature", "datetime", "date", "time", "datePeriod", "timePeriod", "percentage")
GAZETTEER_KINDS = ("musicAlbum", "musicArtist", "musicTrack", "city", "country", "region")
BUILTIN_KINDS = GRAMMAR_KINDS + GAZETTEER_KINDS



def is_builtin(kind: Column) -> Column:
    return kind.isin(*BUILTIN_KINDS)


def builtin_matches(texts: DataFrame, keys: list[str], kinds: tuple[str, ...] = GRAMMAR_KINDS, language: str = "en") -> DataFrame:
    """keys, kind, s, e, value, number, unit of each builtin entity. texts: keys, text.

    A grammar reads a token with its neighbours: numbers with a fraction or in words, $ before and % behind a number, ordinals,
    numbers with a unit of temperature or time and compounds of these, dates, times, periods and intervals. Each kind is matched for itself, so kinds overlap;
    `keep_longest` removes that. Case does not matter and offsets are those of the original text. All of it
    happens within the row: a map without shuffle.
    """
    found = grammar.with_entities(texts.select(*keys, "text"), "text", kinds, language, "__m")
    return text.each(found, keys, F.col("__m"), "__m").select(*keys, "__m.*")


def resolved_values(slots: DataFrame, kind: str, raw: str, resolved: str, language: str = "en", name: str = "value", reference: Column | None = None) -> DataFrame:
    """slots with what each stands for, as JSON: a custom entity's resolved value, or a builtin one's number and unit as its grammar reads them from the raw text, or the
    instants that a date or time means at a reference instant (now, if none is given; see `calendar.with_meaning`)."""
    keep = slots.columns
    read = grammar.with_entities(slots, raw, GRAMMAR_KINDS, language, "__read")
    read = read.withColumn("__read", F.get(F.filter("__read", lambda m: m["kind"] == F.col(kind)), 0))
    read = calendar.with_meaning(read, kind, raw, F.current_timestamp() if reference is None else reference, language, "__when")
    whole = lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    said = F.initcap(F.regexp_replace(F.col(kind), "([A-Z])", " $1"))
    number = F.to_json(F.struct(said.alias("kind"), F.coalesce(whole(F.col("__read.number")), F.col(resolved)).alias("value"), F.col("__read.unit").alias("unit")))
    custom = F.to_json(F.struct(F.lit("Custom").alias("kind"), F.col(resolved).alias("value")))
    value = F.when(~is_builtin(F.col(kind)), custom).when(F.col("__when").isNotNull(), F.to_json("__when")).otherwise(number)
    return read.select(*keep, value.alias(name))


def gazetteer(values: DataFrame) -> DataFrame:
    """kind, norm, resolved, n_tokens from kind, surface, resolved: surfaces normalised and tokenised; of surfaces that become
    equal, the one with the first resolved value stays."""
    cut = text.tokenize_light(text.normalize(F.col("surface")))
    made = values.select("kind", F.array_join(cut, " ").alias("norm"), "resolved", F.size(cut).alias("n_tokens")).where("n_tokens > 0")
    return made.groupBy("kind", "norm", "n_tokens").agg(F.min("resolved").alias("resolved"))


def with_parts(entries: DataFrame, strictness: DataFrame) -> DataFrame:
    """entries (kind, norm, n_tokens, resolved) and, of kinds whose strictness (kind, strictness) is below one, the runs of tokens in them that have at least
    that share of an entry's tokens, so that a text matches with a part of an entry.

    An entry's own form stays its own; a run that several entries have stands for the one of which it is the largest share, then the first resolved value.
    """
    loose = entries.join(strictness.where("strictness < 1"), "kind")
    words, n = F.split("norm", " "), F.col("n_tokens")
    least = F.greatest(F.lit(1), F.ceil(F.col("strictness") * n - 1e-9).cast("int"))
    sizes = F.when(least < n, F.sequence(least, n - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda a: F.struct(F.array_join(F.slice(words, a, k), " ").alias("norm"), k.alias("n_tokens"), (k / n).alias("share")))))
    cut = loose.select("kind", "resolved", F.explode(runs).alias("r")).select("kind", "r.norm", "r.n_tokens", "r.share", "resolved")
    best = cut.groupBy("kind", "norm", "n_tokens").agg(F.min(F.struct(-F.col("share"), "resolved")).alias("x")).select("kind", "norm", "n_tokens", "x.resolved")
    own = entries.select("kind", "norm", "n_tokens", "resolved")
    return own.unionByName(best.join(own.select("kind", "norm"), ["kind", "norm"], "left_anti"))


def entry_lengths(entries: DataFrame) -> list[int]:
    """How many tokens entries have: a dictionary's few lengths, so that only n-grams of those lengths are looked up, and none is missed."""
    return sorted(entry_counts(entries))


def entry_counts(entries: DataFrame) -> dict[int, int]:
    """How many entries there are of each number of tokens."""
    return {r["n_tokens"]: r["count"] for r in entries.groupBy("n_tokens").count().collect()}


def first_words(entries: DataFrame) -> list[str] | None:
    """The different words that entries begin with, if they are at most joins.LITERALS, else None."""
    return joins.few_values(entries.select(F.element_at(F.split("norm", " "), 1).alias("word")), "word")


def gazetteer_matches(texts: DataFrame, keys: list[str], entries: DataFrame, longest: int | list[int] | None = None) -> DataFrame:
    """keys, kind, s, e, value, resolved of every n-gram that is an entry. texts: keys, text.

    longest: the lengths of n-grams that are looked up, or all up to a length; None: those that the entries have. The n-grams are cut
    within the row, so nothing is shuffled before the join with the dictionary. Where entries begin with few different words, only n-grams that begin with one of these are cut.
    """
    counts, words = entry_counts(entries), first_words(entries)
    sizes = sorted(counts) if longest is None else list(range(1, longest + 1)) if isinstance(longest, int) else list(longest)
    if not sizes:
        sizes = [1]

    def grams(norms: Column) -> Column:
        """Places and words of the n-grams."""
        every = F.when(F.size(norms) > 0, F.sequence(F.lit(0), F.size(norms) - 1)).otherwise(F.array().cast("array<int>"))
        starts = every if words is None else F.filter(every, lambda i: F.get(norms, i).isin(*words))
        gram = lambda i, k: F.struct(F.array_join(F.slice(norms, i + 1, F.lit(k)), " ").alias("norm"), i.alias("i"), F.lit(k).alias("k"))
        return F.flatten(F.transform(starts, lambda i: F.array_compact(F.array(*[F.when(i + k <= F.size(norms), gram(i, k)) for k in sizes]))))

    def placed(pieces: Column, found: Column) -> Column:
        def of(toks: Column) -> Column:
            return F.transform(found, lambda g: text.bind(F.struct(F.get(toks, g["i"]).alias("a"), F.get(toks, g["i"] + g["k"] - 1).alias("z")), lambda b: F.struct(g["norm"].alias("norm"), b["a"]["s"].alias("s"), b["z"]["e"].alias("e"), text.covered(pieces, b["a"], b["z"]).alias("value"))))

        return F.when(F.size(found) > 0, text.bind(text.numbered(pieces), of))

    norms = F.transform(text.tokenize_light(F.col("text")), text.normalize)
    cut = text.bind(text.bind(norms, grams), lambda found: text.bind(text.cut_pieces(F.col("text")), lambda pieces: placed(pieces, found)))
    found = text.each(texts, keys, cut, "g").select(*keys, "g.*")
    return joins.with_few(found, entries.select("norm", "kind", "resolved"), "norm", rows=sum(counts.values())).select(*keys, "kind", "s", "e", "value", "resolved")


def partial_matches(texts: DataFrame, keys: list[str], entries: DataFrame, strictness: float | Column) -> DataFrame:
    """keys, kind, resolved, share of entries of which at least that share of tokens is in the text.

    A word counts as often as the entry has it, if the text has it as often. strictness: a number, or a column of entries.
    """
    words = entries.withColumn("least", F.lit(strictness) if isinstance(strictness, int | float) else strictness)
    words = words.select("kind", "norm", "resolved", "n_tokens", "least", F.explode(F.split("norm", " ")).alias("word")).groupBy("kind", "norm", "resolved", "n_tokens", "least", "word").agg(F.count("*").alias("wanted"))
    toks = text.tokens(texts.select(*keys, "text"), keys).groupBy(*keys, text.normalize(F.col("value")).alias("word")).agg(F.count("*").alias("there"))
    found = joins.by_key(toks, words, "word").groupBy(*keys, "kind", "norm", "resolved", "n_tokens", "least").agg((F.sum(F.least("wanted", "there")) / F.col("n_tokens")).alias("share"))
    return found.where(F.col("share") >= F.col("least")).select(*keys, "kind", "resolved", "share")


def with_norms(texts: DataFrame, keys: list[str], stems: DataFrame | None = None) -> DataFrame:
    """keys, text, __toks and __norms: the tokens of each text and what dictionaries know them by, normalised forms or, with stems (form, stem; of a form with several the first), the stems of these.
    Without stems all is made within the row."""
    rows = texts.select(*keys, "text", text.token_array(F.col("text")).alias("__toks")).withColumn("__norms", F.transform("__toks", lambda t: text.normalize(t["value"])))
    if stems is None:
        return rows
    each = text.each(rows, keys, F.transform("__norms", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), "t").select(*keys, "t.*")
    each = lexicon.look_up(each, stems.groupBy("form").agg(F.min("stem").alias("stem")), "w", "form", "stem", "stem", F.col("w"))
    held = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "stem"))), lambda x: x["stem"]).alias("__stems"))
    return joins.by_key(rows, held, keys, "left").select(*keys, "text", "__toks", F.coalesce("__stems", "__norms").alias("__norms"))


def stem_entries(entries: DataFrame, stems: DataFrame) -> DataFrame:
    """kind, norm, n_tokens, resolved: entries with stems (form, stem) in place of words; of those that become equal, the one with the first resolved value stays."""
    each = text.each(entries, ["kind", "norm", "n_tokens", "resolved"], F.transform(F.split("norm", " "), lambda w, i: F.struct(i.alias("i"), w.alias("w"))), "t").select("kind", "norm", "n_tokens", "resolved", "t.*")
    each = lexicon.look_up(each, stems.groupBy("form").agg(F.min("stem").alias("stem")), "w", "form", "stem", "stem", F.col("w"))
    made = each.groupBy("kind", "norm", "n_tokens", "resolved").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "stem"))), lambda x: x["stem"]), " ").alias("stemmed"))
    return made.groupBy("kind", F.col("stemmed").alias("norm"), "n_tokens").agg(F.min("resolved").alias("resolved"))


def stemmed_matches(texts: DataFrame, keys: list[str], entries: DataFrame, stems: DataFrame, longest: list[int] | None = None) -> DataFrame:
    """keys, kind, s, e, value, resolved of every run of tokens whose stems are an entry of stems (`stem_entries`). Offsets and values are those of the text as it is. texts: keys, which tell texts
    apart, and text; longest: the lengths of runs that are looked up, those that entries have if none are given."""
    counts = entry_counts(entries)
    sizes = (sorted(counts) if longest is None else list(longest)) or [1]

    def cut(toks: Column, norms: Column) -> Column:
        gram = lambda t, i, k: F.struct(F.array_join(F.slice(norms, i + 1, F.lit(k)), " ").alias("norm"), t["s"].alias("s"), F.get(toks, i + k - 1)["e"].alias("e"))
        return F.flatten(F.transform(toks, lambda t, i: F.array_compact(F.array(*[F.when(i + k <= F.size(toks), gram(t, i, k)) for k in sizes]))))

    grams = text.bind(F.col("__toks"), lambda toks: text.bind(F.col("__norms"), lambda norms: cut(toks, norms)))
    each = text.each(with_norms(texts, keys, stems), keys, grams, "g").select(*keys, "g.*")
    found = joins.with_few(each, entries.select("norm", "kind", "resolved"), "norm", rows=sum(counts.values()))
    value = F.substr("text", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int"))
    return joins.by_key(found, texts.select(*keys, "text"), keys).select(*keys, "kind", "s", "e", value.alias("value"), "resolved")


def frequent_words(entries: DataFrame, share: float = 0.001) -> DataFrame:
    """kind, word: of each kind's different words so large a share, the most frequent ones, ties by name. They are a dictionary's stop words: a part of an entry that has nothing else is no match."""
    if not 0 < share < 1:
        raise ValueError("the share of stop words must lie between 0 and 1")
    words = text.each(entries, ["kind"], F.split("norm", " "), "word").groupBy("kind", "word").agg(F.count("*").alias("often"))
    many = words.groupBy("kind").agg(F.floor(F.count("*") * share).alias("many")).where("many > 0")
    own = words.join(F.broadcast(many), "kind")
    ranked = ordering.numbered(own, F.struct(-F.col("often"), F.substring("word", 1, 2)), [F.desc("often"), "word"], ["kind"])
    return ranked.where("n < many").select("kind", "word")


def filed(entries: DataFrame, strictness: DataFrame) -> DataFrame:
    """kind, norm, resolved, n_tokens, least, word and next: entries of kinds whose strictness (kind, strictness) is below one, filed under each word that a match may begin with, and those that may follow it
    there. A match that has `least` of n tokens begins with two of the first n - least + 2, in their order; where one token is enough it may begin with any, and next is null. At most a row for each token of the dictionary."""
    loose = entries.join(F.broadcast(strictness.where("strictness < 1")), "kind")
    loose = loose.select("kind", "norm", "resolved", "n_tokens", F.greatest(F.lit(1), F.ceil(F.col("strictness") * F.col("n_tokens") - 1e-9).cast("int")).alias("least"))
    words, last = F.split("norm", " "), F.col("n_tokens") - F.col("least") + 2
    follow = lambda i: F.when(F.col("least") > 1, F.array_distinct(F.slice(words, i + 2, F.greatest(last - i - 1, F.lit(0)).cast("int"))))
    begins = F.transform(F.slice(words, F.lit(1), last - 1), lambda w, i: F.struct(w.alias("word"), follow(i).alias("next")))
    return text.each(loose, ["kind", "norm", "resolved", "n_tokens", "least"], begins, "b").select("kind", "norm", "resolved", "n_tokens", "least", "b.*")


def fetched(said: DataFrame, keys: list[str], entries: DataFrame, strictness: DataFrame) -> DataFrame:
    """keys, kind, norm, resolved, least of the entries that a match in a text may be of, each once. said: keys and __norms, the words of a text.

    An entry that needs two tokens and more is fetched by a pair of words that stand side by side in the text. There are far more pairs than words, so they fetch few entries where a frequent word fetches a large
    share of them all.
    """
    begins = F.when(F.col("next").isNull(), F.array("word")).otherwise(F.transform("next", lambda w: F.concat_ws(" ", "word", w)))
    index = text.each(filed(entries, strictness), ["kind", "norm", "resolved", "least"], begins, "begin")
    pairs = F.transform("__norms", lambda w, i: F.concat_ws(" ", w, F.get("__norms", i + 1)))
    offered = text.each(said, keys, F.array_distinct(F.concat("__norms", pairs)), "begin")
    return joins.by_key(offered, index, "begin").select(*keys, "kind", "norm", "resolved", "least").distinct()


def gapped_runs(toks: Column, words: Column, least: Column, stops: Column) -> Column:
    """Structs i, n of the maximal runs of tokens that are words of an entry in its order, with some of the entry's words left out: at least `least` tokens, of which one is no stop word unless
    the entry is whole. toks: normalised tokens of a text; words: those of the entry."""

    def run(i: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            found = F.array_position(F.slice(words, acc["at"] + 1, F.size(words)), t).cast("int")
            on = ~acc["done"] & (found > 0)
            return F.struct(F.when(on, acc["at"] + found).otherwise(acc["at"]).alias("at"), (acc["n"] + on.cast("int")).alias("n"), (~on).alias("done"))

        return F.aggregate(F.slice(toks, i + 1, F.size(words)), F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(False).alias("done")), step, lambda acc: acc["n"])

    starts = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: F.array_contains(words, F.get(toks, i)))
    runs = F.transform(starts, lambda i: F.struct(i.alias("i"), run(i).alias("n")))
    said = lambda r: (r["n"] == F.size(words)) | F.exists(F.slice(toks, r["i"] + 1, r["n"]), lambda t: ~F.array_contains(stops, t))
    within = lambda rs, r: F.exists(rs, lambda q: (q["i"] <= r["i"]) & (r["i"] + r["n"] <= q["i"] + q["n"]) & (q["n"] > r["n"]))
    return text.bind(runs, lambda rs: F.filter(rs, lambda r: (r["n"] >= least) & said(r) & ~within(rs, r)))


def gapped_matches(texts: DataFrame, keys: list[str], entries: DataFrame, strictness: DataFrame, stop_words: DataFrame | None = None, stems: DataFrame | None = None) -> DataFrame:
    """keys, kind, s, e, value, resolved, share of entries of kinds with a strictness below one (kind, strictness): a run of a text's tokens that are words of an entry, in its order, and at least
    that share of them. Words of an entry may be left out anywhere; words between those of the text may not. Of the entries that a span matches the one of which it is the largest share stands
    for it, then the first resolved value. texts: keys, which tell texts apart, and text; stop_words: kind, word, of which alone no part of an entry is made;
    stems: form, stem, by which the text's words are read if entries are of stems (`stem_entries`).

    Texts whose words are the same are tried once. Candidates are fetched by pairs of words (`fetched`); each is tried against its text's tokens exactly, within the row.
    """
    rows = with_norms(texts, keys, stems).withColumn("__said", F.sha2(F.array_join("__norms", " "), 256))
    said = rows.groupBy("__said").agg(F.first("__norms").alias("__norms"))
    candidates = fetched(said, ["__said"], entries, strictness)
    if stop_words is None:
        candidates = candidates.withColumn("__stops", F.array().cast("array<string>"))
    else:
        held = stop_words.groupBy("kind").agg(F.collect_set("word").alias("__stops"))
        candidates = candidates.join(F.broadcast(held), "kind", "left").withColumn("__stops", F.coalesce("__stops", F.array().cast("array<string>")))
    tried = joins.by_key(candidates, said, "__said").withColumn("__words", F.split("norm", " "))
    runs = text.each(tried, ["__said", "kind", "resolved", "__words"], gapped_runs(F.col("__norms"), F.col("__words"), F.col("least"), F.col("__stops")), "r")
    found = runs.select("__said", "kind", "r.i", "r.n", F.struct((-F.col("r.n") / F.size("__words")).alias("less"), "resolved").alias("b"))
    best = found.groupBy("__said", "kind", "i", "n").agg(F.min("b").alias("b"))
    placed = joins.by_key(rows, best, "__said")
    start, end = F.get("__toks", F.col("i"))["s"], F.get("__toks", F.col("i") + F.col("n") - 1)["e"]
    return placed.select(*keys, "kind", start.alias("s"), end.alias("e"), F.substr("text", (start + 1).cast("int"), (end - start).cast("int")).alias("value"), "b.resolved", (-F.col("b.less")).alias("share"))


def keep_longest(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches without overlap: longest first, then builtin before custom, then by start, each kept if it overlaps none kept.

    An utterance's matches are few, so they are folded in an array; nothing else is gathered.
    """
    item = F.struct((-(F.col("e") - F.col("s"))).alias("order"), (~is_builtin(F.col("kind"))).alias("custom"), "s", "e", "kind", *[c for c in matches.columns if c not in (*keys, "s", "e", "kind")])
    listed = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    overlap = lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"])
    kept = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.array_append(acc, x)))
    return text.each(listed, keys, kept, "m").select(*keys, *[f"m.{c}" for c in matches.columns if c not in keys])


def replace_with_placeholders(texts: DataFrame, matches: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, rewritten) with every match replaced by %KIND%, and (keys, n, kind, s, e, value, new_s, new_e).

    matches do not overlap. Offsets after the rewrite are running sums of length differences.
    """
    both = rewrite(texts, matches, keys)
    return both.select(*keys, "rewritten"), both.select(*keys, F.explode_outer("found").alias("x")).where("x IS NOT NULL").select(*keys, *[f"x.{c}" for c in ("n", "kind", "s", "e", "value", "new_s", "new_e")])


def rewrite(texts: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rewritten, found (array of n, kind, s, e, value, new_s, new_e by s; null for none): an utterance's matches, which are few,
    meet its text in one join, and all else happens within the row."""
    listed = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind", "value"))).alias("held"))
    joined = joins.by_key(texts.select(*keys, "text"), listed, keys, "left")
    return joined.select(*keys, "text", replaced(F.col("text"), F.col("held")).alias("x")).select(*keys, "x.rewritten", "x.found")


def replaced(source: Column, held: Column) -> Column:
    """Struct of rewritten and found for a text and its sorted matches (array of s, e, kind, value)."""
    mark = lambda m: text.placeholder(m["kind"])
    grown = F.transform(held, lambda m: (F.length(mark(m)) - (m["e"] - m["s"])).cast("int"))

    def of(shifts: Column) -> Column:
        found = F.transform(held, lambda m, i: F.struct(
            i.cast("long").alias("n"), m["kind"].alias("kind"), m["s"].alias("s"), m["e"].alias("e"), m["value"].alias("value"),
            (m["s"] + F.get(shifts, i)).cast("long").alias("new_s"), (m["e"] + F.get(shifts, i + 1)).cast("long").alias("new_e")))
        start = lambda i: F.coalesce(F.get(held, i - 1)["e"], F.lit(0))
        cut = F.transform(held, lambda m, i: F.concat(F.substr(source, (start(i) + 1).cast("int"), (m["s"] - start(i)).cast("int")), mark(m)))
        tail = F.substr(source, (F.coalesce(F.element_at(held, -1)["e"], F.lit(0)) + 1).cast("int"))
        return F.struct(F.concat(F.coalesce(F.array_join(cut, ""), F.lit("")), F.when(F.size(held) > 0, tail).otherwise(source)).alias("rewritten"), found.alias("found"))

    return text.bind(F.when(held.isNotNull(), text.running_sums(grown)), of)


def covering(tokens: DataFrame, matches: DataFrame, keys: list[str], scheme: str = "BIO") -> DataFrame:
    """Feature of tokens inside a match: keys, i, kind, tag (prefix of the scheme by the token's place in its first covering match)."""
    inside = joins.by_key(tokens, matches.select(*keys, "kind", F.col("s").alias("ms"), F.col("e").alias("me")), keys).where("ms <= s AND e <= me")
    first = W.partitionBy(*keys, "i", "kind").orderBy("ms", "me")
    inside = inside.withColumn("r", F.row_number().over(first)).where("r = 1")
    span = W.partitionBy(*keys, "kind", "ms", "me")
    place, size = F.row_number().over(span.orderBy("i")), F.count("*").over(span)
    return inside.select(*keys, "i", "kind", scheme_prefix(place, size, scheme).alias("tag"))


def scheme_prefix(place: Column, size: Column, scheme: str) -> Column:
    """I-, B-, L- or U- for the place (from 1) in a span of a size under IO, BIO or BILOU."""
    if scheme == "IO":
        return F.lit("I-")
    if scheme == "BIO":
        return F.when(place == 1, "B-").otherwise("I-")
    if scheme == "BILOU":
        return F.when(size == 1, "U-").when(place == 1, "B-").when(place == size, "L-").otherwise("I-")
    raise ValueError(f"unknown tagging scheme {scheme!r}")
