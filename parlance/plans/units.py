"""The engine's own units: lookup, pattern and probabilistic parsers, a classifier, and slot fillers."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.errors import MissingResourceError, RegistryError
from parlance.functions import text
from parlance.operators import classifier, crf, entities, grammar, joins, parsers, sampling, tagging
from parlance.operators.token_features import token_features
from parlance.plans.config import ClassifierConfig, EngineConfig, KeywordConfig, LookupConfig, PatternConfig, ProbabilisticConfig, SlotFillerConfig, unit_config
from parlance.plans.plugins import CLASSIFIERS, ENTITY_PARSERS, PARSERS, SLOT_FILLERS, EntityParser, IntentClassifier, IntentParser, SlotFiller, Unit

#: Filler for noise where the resources have none.
NOISE = "time people way water words day part number sound work place years back thing name sentence man line boy follow form small end put home hand large big even land here must high such act ask men change light kind off need house picture try us again animal point mother world near build self earth father".split()


def small(df: DataFrame) -> DataFrame:
    """A table of a dataset's size, computed once and held as rows of the plan itself."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def find_entities(
    texts: DataFrame,
    entries: DataFrame,
    lengths: list[int] | int | None = None,
    kinds: tuple[str, ...] = entities.GRAMMAR_KINDS,
    language: str = "en",
    loose: dict[str, float] | None = None,
    matching: str = "plain",
    stemmed: DataFrame | None = None,
    stems: DataFrame | None = None,
) -> DataFrame:
    """id, kind, s, e, value, resolved of builtin entities of those kinds and of dictionary entries. loose: strictness of those kinds of entries that match by parts.

    matching: by the forms of words ("plain"), by their stems ("stemmed": entries `stemmed` of `entities.stem_entries`), or by either ("both"), where a span that matches by its form is not matched
    by its stems.
    """
    spark = texts.sparkSession
    strict = spark.createDataFrame(list(loose.items()), "kind string, strictness double") if loose else None

    def found_in(own: DataFrame, by: DataFrame | None) -> DataFrame:
        whole = own.where(~F.col("kind").isin(*loose)) if loose else own
        found = entities.gazetteer_matches(texts, ["id"], whole, lengths) if by is None else entities.stemmed_matches(texts, ["id"], whole, by, lengths)
        if not loose:
            return found
        parts = own.where(F.col("kind").isin(*loose))
        return found.unionByName(entities.gapped_matches(texts, ["id"], parts, strict, entities.frequent_words(parts), by).drop("share"))

    if matching == "plain":
        found = found_in(entries, None)
    elif matching == "stemmed":
        found = found_in(stemmed, stems)
    else:
        ranked = found_in(entries, None).withColumn("by", F.lit(0)).unionByName(found_in(stemmed, stems).withColumn("by", F.lit(1)))
        found = ranked.groupBy("id", "kind", "s", "e", "value").agg(F.min(F.struct("by", "resolved")).alias("x")).select("id", "kind", "s", "e", "value", "x.resolved")
    if not kinds:
        return found
    builtin = entities.builtin_matches(texts, ["id"], kinds, language).select("id", "kind", "s", "e", "value", F.col("value").alias("resolved"))
    return builtin.unionByName(found)


@dataclass
class Training:
    """What units are fitted on: the tables of a dataset. All are as small as it is."""

    spark: SparkSession
    config: EngineConfig
    language: str
    texts: DataFrame  # id, intent, text
    slots: DataFrame  # id, intent, n, slot_name, entity, s, e, raw_value
    surfaces: DataFrame  # entity, surface, resolved
    entries: DataFrame  # kind, norm, n_tokens, resolved
    trained: DataFrame  # id, intent, rewritten
    stops: DataFrame  # intent, words
    resources: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    kinds: tuple[str, ...] = entities.GRAMMAR_KINDS  # the builtin entities that the dataset has
    loose: dict[str, float] = field(default_factory=dict)  # strictness of the entities that match by parts
    matching: str = "plain"  # what entries are matched by: plain, stemmed or both
    stemmed: DataFrame | None = None  # entries of stems, where they are matched by these

    def found(self, texts: DataFrame) -> DataFrame:
        stems = None if self.matching == "plain" else self.resources["stems"]["stems"]
        return small(find_entities(texts, self.entries, None, self.kinds, self.language, self.loose, self.matching, self.stemmed, stems))

    def required(self, needed: dict[str, set[str]]) -> dict[str, dict[str, DataFrame]]:
        """The resources that a unit needs; one that was not given raises."""
        for kind, names in needed.items():
            for name in names:
                if name not in self.resources.get(kind, {}):
                    raise MissingResourceError(f"{kind}/{name}")
        return {kind: {name: self.resources[kind][name] for name in names} for kind, names in needed.items()}

    def noise(self) -> DataFrame:
        """ord, word."""
        held = self.resources.get("noise", {})
        return next(iter(held.values())) if held else self.spark.createDataFrame(list(enumerate(NOISE)), "ord long, word string")

    def augmented(self, least: int, capitalization_ratio: float | None = None) -> tuple[DataFrame, DataFrame]:
        """texts (id, intent, text) and slots (id, n, slot_name, entity, s, e): templates in turn with shuffled values in their slots. With a ratio, so
        many of an entity's values are in title case and the others in lower case."""
        seed = self.config.seed
        named = self.slots.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "slot_name", "entity"))), lambda x: F.struct(x["slot_name"], x["entity"])).alias("named"))
        by = W.partitionBy("intent")
        t = self.trained.join(named, "id", "left")
        t = t.withColumn("k", F.row_number().over(by.orderBy(sampling.order(seed, F.col("id")))) - 1).withColumn("n", F.count("*").over(by))
        many = t.select("intent", "n").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(least)).cast("int") - 1)))
        rows = many.withColumn("k", F.pmod("i", "n")).join(t.drop("n"), ["intent", "k"]).withColumn("id", F.abs(F.xxhash64("intent", "i")))
        values = self.surfaces.select("entity", F.col("surface").alias("value")).unionByName(self.slots.select("entity", F.col("raw_value").alias("value"))).distinct()
        values = sampling.shuffled(values.distinct(), ["entity"], "value", seed).withColumnsRenamed({"k": "vk", "n": "vn"})
        sizes = values.select("entity", "vn").distinct()
        parts = rows.select("id", "intent", "i", F.split("rewritten", text.MARK, -1).alias("gaps"), F.posexplode_outer("named").alias("p", "slot"))
        drawn = parts.withColumn("entity", F.col("slot.entity")).join(sizes, "entity", "left").withColumn("vk", F.pmod(F.col("i") * 7 + F.col("p"), "vn"))
        drawn = drawn.join(values.select("entity", "vk", "value"), ["entity", "vk"], "left")
        if capitalization_ratio is not None:
            spoken = F.when(sampling.draw(seed, F.col("id"), F.col("p")) <= capitalization_ratio, text.title(F.lower("value"))).otherwise(F.lower("value"))
            drawn = drawn.withColumn("value", F.when(entities.is_builtin(F.col("entity")), F.col("value")).otherwise(spoken))
        cut = drawn.withColumn("gap", F.element_at("gaps", F.coalesce("p", F.lit(0)) + 1)).withColumn("chars", F.length("gap") + F.coalesce(F.length("value"), F.lit(0)))
        before = W.partitionBy("id").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
        placed = cut.withColumn("s", F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.length("gap")).withColumn("e", F.col("s") + F.length("value"))
        joined = placed.groupBy("id", "intent").agg(F.array_sort(F.collect_list(F.struct("p", F.concat("gap", F.coalesce("value", F.lit(""))).alias("t")))).alias("ts"), F.first("gaps").alias("gaps"), F.count("p").alias("np"))
        tail = F.when(F.col("np") > 0, F.element_at("gaps", -1)).otherwise("")
        texts = joined.select("id", "intent", F.concat(F.array_join(F.transform("ts", lambda x: x["t"]), ""), tail).alias("text"))
        made = placed.where("slot IS NOT NULL").select("id", F.col("p").cast("long").alias("n"), "slot.slot_name", "entity", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
        return small(texts), small(made)


@dataclass
class Prepared:
    """Texts to parse (id, text) and all entities found in them (id, kind, s, e, value, resolved), with what units have made of them so far. hold: caches
    what is read twice."""

    texts: DataFrame
    matches: DataFrame
    resources: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    made: dict = field(default_factory=dict)
    hold: Callable[[DataFrame], DataFrame] = lambda df: df

    def only(self, ids: DataFrame) -> Prepared:
        """The same for some of the texts."""
        return Prepared(joins.by_key(self.texts, ids.select("id"), "id", "left_semi"), joins.by_key(self.matches, ids.select("id"), "id", "left_semi"), self.resources, hold=self.hold)


def load_unit(spark: SparkSession, path: str) -> Unit:
    """A unit that was saved by itself, of whatever kind its configuration says."""
    config = unit_config(json.loads("".join(r[0] for r in spark.read.text(f"{path}/configuration").collect())))
    for registry in (PARSERS, CLASSIFIERS, SLOT_FILLERS, ENTITY_PARSERS):
        if config.unit in registry.held:
            return registry.by_name(config.unit)(config).load(spark, path)
    raise RegistryError(f"no unit {config.unit!r} is registered")


def _known(kinds: list[str] | None, held: list[str]) -> list[str]:
    if unknown := sorted(set(kinds or []) - set(held)):
        raise ValueError(f"no such entities: {', '.join(unknown)}; there are: {', '.join(held) or 'none'}")
    return sorted(set(kinds)) if kinds is not None else held


@ENTITY_PARSERS.register("custom_entities")
class CustomEntityParser(EntityParser):
    """The entities of a dataset, by its dictionary. Its option `matching` says what values are matched by: plain (forms of words), stemmed or both."""

    schemas = {"entries": "kind string, norm string, n_tokens int, resolved string", "loose": "kind string, strictness double", "stemmed": "kind string, norm string, n_tokens int, resolved string", "stems": "form string, stem string"}

    @property
    def matching(self) -> str:
        asked = self.config.options.get("matching", "plain")
        if asked not in ("plain", "stemmed", "both"):
            raise ValueError(f"unknown matching {asked!r}")
        return asked

    def fit(self, training: Training) -> CustomEntityParser:
        make, by_stems = training.spark.createDataFrame, self.matching != "plain"
        stems = training.required({"stems": {"stems"}})["stems"]["stems"].select("form", "stem") if by_stems else make([], self.schemas["stems"])
        stemmed = small(entities.stem_entries(training.entries, stems).select("kind", "norm", "n_tokens", "resolved")) if by_stems else make([], self.schemas["stemmed"])
        self.tables = {"entries": training.entries, "loose": make(list(training.loose.items()), self.schemas["loose"]), "stemmed": stemmed, "stems": stems}
        return self

    def parse(self, texts: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        entries = self.checked().tables["entries"]
        asked = _known(kinds, sorted(r["kind"] for r in entries.select("kind").distinct().collect()))
        loose = {r["kind"]: r["strictness"] for r in self.tables["loose"].collect() if r["kind"] in asked}
        own = lambda df: df.where(F.col("kind").isin(*asked))
        return find_entities(texts.select("id", "text"), own(entries), None, (), loose=loose, matching=self.matching, stemmed=own(self.tables["stemmed"]), stems=self.tables["stems"])


@ENTITY_PARSERS.register("builtin_entities")
class BuiltinEntityParser(EntityParser):
    """The builtin entities that a dataset has, by the grammars of its language."""

    schemas = {"kinds": "kind string, language string"}

    def fit(self, training: Training) -> BuiltinEntityParser:
        self.tables = {"kinds": training.spark.createDataFrame([(k, training.language) for k in training.kinds], self.schemas["kinds"])}
        return self

    def parse(self, texts: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        held = self.checked().tables["kinds"].collect()
        asked = _known(kinds, sorted(r["kind"] for r in held))
        found = entities.builtin_matches(texts.select("id", "text"), ["id"], tuple(asked), held[0]["language"] if held else "en")
        return found.select("id", "kind", "s", "e", "value", F.col("value").alias("resolved"))


def _scoped(df: DataFrame, intents: list[str] | None) -> DataFrame:
    return df.where(F.col("intent").isNull() | F.col("intent").isin(*intents)) if intents else df


class _Walker(IntentParser):
    """A parser whose models are sequences of tokens and placeholders (see `parsers.find`)."""

    order: tuple = ()

    def hits(self, prepared: Prepared) -> DataFrame:
        if self not in prepared.made:
            found = parsers.find(prepared.texts, prepared.matches, self.checked().tables["models"], ["id"])
            prepared.made[self] = prepared.hold(parsers.first_of_intent(found, ["id"], *self.order))
        return prepared.made[self]

    def candidates(self, prepared: Prepared, intents: list[str] | None = None) -> DataFrame:
        return parsers.reweight(_scoped(self.hits(prepared), intents).select("id", "intent", "n_slots"))

    def slots(self, prepared: Prepared, chosen: DataFrame) -> DataFrame:
        own = joins.by_key(self.hits(prepared), chosen.select("id", "intent"), ["id", "intent"], "left_semi")
        rows = parsers.slot_rows(own, ["id"]).where("slot_name IS NOT NULL")
        return rows.select("id", "intent", "slot_name", F.col("kind").alias("entity"), "s", "e", F.col("value").alias("raw_value"))


@PARSERS.register("lookup")
class LookupParser(_Walker):
    """Utterances seen in training, whatever values their slots have."""

    config_type = LookupConfig
    schemas = {"models": "intent string, slot_names array<string>, n_slots long, parts array<string>, stops array<string>, filed string"}
    order = ("n_slots",)

    def fit(self, training: Training) -> LookupParser:
        stops = training.stops if self.config.ignore_stop_words else None
        self.tables = {"models": small(parsers.indexed(parsers.build_lookup(training.trained, training.slots, stops).drop("key")))}
        return self


@PARSERS.register("pattern")
class PatternParser(_Walker):
    """The first pattern of each intent that fits; patterns that two intents share serve none."""

    config_type = PatternConfig
    schemas = {"models": "intent string, ord long, slot_names array<string>, n_slots long, parts array<string>, stops array<string>, filed string"}
    order = ("ord",)

    def fit(self, training: Training) -> PatternParser:
        stops = training.stops if self.config.ignore_stop_words else None
        made = parsers.build_patterns(training.trained, training.slots, self.config.max_queries, self.config.max_pattern_length, stops)
        self.tables = {"models": small(parsers.indexed(made.drop("pattern")))}
        return self


@CLASSIFIERS.register("log_reg")
class LogRegClassifier(IntentClassifier):
    config_type = ClassifierConfig
    schemas = {"weights": "intent string, term string, weight double", "idf": "term string, idf double", "intercepts": "intent string, b double"}

    def fit(self, training: Training) -> LogRegClassifier:
        c, spark, seed = self.config, training.spark, training.config.seed
        texts, _ = training.augmented(c.min_utterances)
        if c.unknown_word_prob:
            texts = sampling.add_unknown(texts, F.col("id"), "text", c.unknown_word_prob, c.max_unknown_words, seed + 1)
        matches = training.found(texts)
        intents = max(1, training.texts.select("intent").distinct().count())
        many = int(c.noise_factor * texts.count() / intents)
        noise = sampling.noise(spark.range(many).select(F.col("id").alias("i")), training.noise(), 5.0, 2.0, seed)
        noise = noise.select((-1 - F.col("i")).alias("id"), F.col("noise").alias("text"))
        model = classifier.fit(spark, texts, matches, noise, c.noise_reweight_factor, c.featurizer, training.required(c.resources()))
        self.tables = {"weights": small(model.weights), "idf": small(model.idf), "intercepts": model.intercepts}
        return self

    @property
    def model(self) -> classifier.Classifier:
        return classifier.Classifier(**self.checked().tables)

    def terms(self, prepared: Prepared) -> DataFrame:
        return classifier.terms(prepared.texts, prepared.matches, self.config.featurizer, prepared.resources)

    def scores(self, prepared: Prepared) -> DataFrame:
        return self.model.scores(prepared.texts, self.terms(prepared))


@SLOT_FILLERS.register("crf")
class CrfSlotFiller(SlotFiller):
    config_type = SlotFillerConfig
    schemas = {"chain": "intent string, feature string, prev string, tag string, weight double"}

    def __init__(self, config) -> None:
        super().__init__(config)
        self._taggers = None

    def fit(self, training: Training) -> CrfSlotFiller:
        c = self.config
        texts, slots = training.augmented(c.min_utterances, c.capitalization_ratio)
        matches = training.found(texts)
        made = token_features(texts, matches, features=c.features, resources=training.required(c.resources()), train=True, seed=training.config.seed)
        rows = crf.samples(made, slots.select("id", "slot_name", "s", "e"), c.tagging_scheme).join(texts.select("id", "intent"), "id")
        self.tables = {"chain": small(crf.fit(rows, c.c1, c.c2))}
        return self

    def taggers(self) -> dict[str, crf.Tagger]:
        if self._taggers is None:
            self._taggers = crf.taggers(self.checked().tables["chain"].collect())
        return self._taggers

    def spans(self, prepared: Prepared, chosen: DataFrame) -> DataFrame:
        asked = chosen.where("intent IS NOT NULL").select("id", "intent")
        made = token_features(prepared.texts.join(asked, "id", "left_semi"), prepared.matches, features=self.config.features, resources=prepared.resources)
        tags = crf.decode(made.join(asked, "id"), self.taggers())
        return tagging.decode(tags, ["id"], self.config.tagging_scheme).join(asked, "id").select("id", "intent", "slot_name", "s", "e")


@SLOT_FILLERS.register("keyword")
class KeywordSlotFiller(SlotFiller):
    """Tokens that are keywords of a slot; they are given in the configuration and nothing is learned."""

    config_type = KeywordConfig
    schemas = {"keywords": "intent string, keyword string, entity string, slot_name string, ord long"}

    def fit(self, training: Training) -> KeywordSlotFiller:
        rows = [(i, k, e, s) for i, named in sorted(self.config.keywords.items()) for s, words in named.items() for k, e in words.items()]
        self.tables = {"keywords": training.spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], self.schemas["keywords"])}
        return self

    def spans(self, prepared: Prepared, chosen: DataFrame) -> DataFrame:
        toks = text.tokens(prepared.texts, ["id"]).join(chosen.select("id", "intent"), "id")
        return tagging.keyword_slots(toks, self.checked().tables["keywords"], ["id", "intent"], self.config.lowercase, ["intent"]).select("id", "intent", "slot_name", "s", "e")


@PARSERS.register("probabilistic")
class ProbabilisticParser(IntentParser):
    """A classifier for the intent, a slot filler for its slots."""

    config_type = ProbabilisticConfig
    schemas = {"slot_entities": "intent string, slot_name string, entity string"}
    threshold = 0.0

    def __init__(self, config) -> None:
        super().__init__(config)
        self.classifier = CLASSIFIERS.by_name(config.classifier.unit)(config.classifier)
        self.slot_filler = SLOT_FILLERS.by_name(config.slot_filler.unit)(config.slot_filler)

    def children(self) -> dict:
        return {"classifier": self.classifier, "slot_filler": self.slot_filler}

    def fit(self, training: Training) -> ProbabilisticParser:
        mapping = training.slots.groupBy("intent", "slot_name").agg(F.max_by("entity", F.struct("id", "n")).alias("entity"))
        self.tables = {"slot_entities": small(mapping)}
        self.classifier.fit(training)
        self.slot_filler.fit(training)
        return self

    def candidates(self, prepared: Prepared, intents: list[str] | None = None) -> DataFrame:
        return _scoped(self.classifier.scores(prepared), intents).select("id", "intent", "probability")

    def slots(self, prepared: Prepared, chosen: DataFrame) -> DataFrame:
        spans = self.slot_filler.spans(prepared, chosen)
        raw = F.substring(F.col("text"), F.col("s").cast("int") + 1, (F.col("e") - F.col("s")).cast("int"))
        return spans.join(self.checked().tables["slot_entities"], ["intent", "slot_name"]).join(prepared.texts, "id").select("id", "intent", "slot_name", "entity", "s", "e", raw.alias("raw_value"))
