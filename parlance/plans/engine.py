"""The engine: fitted on a dataset, it turns a DataFrame of sentences into intents and resolved slots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance import __version__
from parlance.errors import ExistsError, MissingResourceError, UnknownIntentError, VersionError
from parlance.operators import classifier, entities, joins, lexicon, parsers, variations
from parlance.plans.config import EngineConfig
from parlance.plans.plugins import PARSERS, IntentParser
from parlance.plans.units import Prepared, Training, find_entities, small
from parlance.sources.dataset import Dataset
from parlance.storage import delete, materialize

#: Stop words of English, for parsers that are told to ignore them and have no resource.
STOP_WORDS = {"en": "a an the of to in on at for and or is are be it this that with from by as me my you your i we please can could would will do does".split()}
VALUE = "kind string, value string, unit string, grain string, precision string, `from` string, `to` string"
SLOT = "struct<start:long,end:long,raw_value:string,resolved:string,entity:string,slot_name:string>"
#: The tables that all units share, by name.
SHARED = {"intents": "intent string", "entities": "entity string, extensible boolean, strictness double", "entries": "kind string, norm string, n_tokens int, resolved string", "stemmed": "kind string, norm string, n_tokens int, resolved string"}
RESOURCE = {"stop_words": "word string", "noise": "ord long, word string", "stems": "form string, stem string", "gazetteers": "value string", "word_clusters": "word string, cluster string"}


class IntentEngine:
    """Estimator: `fit(dataset)` gives an IntentEngineModel. resources: a language's tables by kind and name, as `sources.resources.load` gives them."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, resources: dict[str, dict[str, DataFrame]] | None = None) -> None:
        self.spark, self.config, self.resources = spark, config or EngineConfig(), resources or {}

    def fit(self, dataset: Dataset) -> IntentEngineModel:
        """Dictionary and units of a dataset. It is small; what is made of it is too."""
        training = self.training(dataset)
        units = [PARSERS.by_name(p.unit)(p).fit(training) for p in self.config.parsers]
        frames = dataset.frames(self.spark)
        tables = {"intents": small(frames["texts"].select("intent").distinct()), "entities": frames["entities"], "entries": training.entries, "stemmed": training.stemmed}
        return IntentEngineModel(self.spark, self.config, dataset.language, tables, units, training.required(self.config.resources()))

    def training(self, dataset: Dataset) -> Training:
        dataset.validate()
        spark, frames = self.spark, dataset.frames(self.spark)
        texts, slots = frames["texts"], frames["slots"]
        surfaces = small(variations.expand_surfaces(variations.synonym_surfaces(frames["surfaces"]), dataset.language))
        full = entities.gazetteer(surfaces.select(F.col("entity").alias("kind"), "surface", "resolved"))
        entries = small(full.select(*(c.split()[0] for c in SHARED["entries"].split(", "))))
        loose = {name: e.strictness for name, e in dataset.entities.items() if e.strictness < 1 and not e.builtin}
        matching = self.config.matching()
        stemmed = spark.createDataFrame([], SHARED["stemmed"])
        if matching != "plain":
            if "stems" not in self.resources.get("stems", {}):
                raise MissingResourceError("stems/stems")
            stemmed = small(entities.stem_entries(entries, self.resources["stems"]["stems"]).select(*entries.columns))
        trained = small(parsers.training_keys(texts, slots).join(texts.select("id", "intent"), "id"))
        stops = spark.createDataFrame([(w,) for w in STOP_WORDS.get(dataset.language, [])], "word string")
        if "stop_words" in self.resources:
            stops = next(iter(self.resources["stop_words"].values()))
        used = slots.select("intent", "entity").distinct().join(surfaces, "entity").select("intent", F.col("surface").alias("value"))
        each = lexicon.intent_stop_words(texts.select("intent"), stops, lexicon.whitelist(used, stops))
        by_intent = small(each.groupBy("intent").agg(F.array_sort(F.collect_set("word")).alias("words")))
        kinds = tuple(k for k in entities.GRAMMAR_KINDS if k in dataset.entities)
        return Training(spark, self.config, dataset.language, texts, slots, surfaces, entries, trained, by_intent, self.resources, kinds, loose, matching, stemmed)


class IntentEngineModel:
    """A fitted engine. Every method takes a DataFrame with id (long) and text; a batch is parsed as a whole, never row by row."""

    def __init__(self, spark: SparkSession, config: EngineConfig, language: str, tables: dict[str, DataFrame], units: list[IntentParser], resources: dict[str, dict[str, DataFrame]]) -> None:
        self.spark, self.config, self.language, self.tables, self.units, self.resources = spark, config, language, tables, units, resources
        self._lengths, self._kinds, self._loose = None, (), {}
        self._held: list[str] = []

    def _hold(self, df: DataFrame) -> DataFrame:
        """Write what several steps of a parse read to the shared folder: computed once, plans stay short, and an executor may be lost. See `release`."""
        table, path = materialize(df, "parse")
        self._held.append(path)
        return table

    def release(self) -> None:
        """Delete the tables that parses have written on the way, once their results are read or written; else they go when the driver ends."""
        while self._held:
            delete(self._held.pop())

    def _scope(self, intents: list[str] | None) -> list[str] | None:
        if intents:
            known = {r["intent"] for r in self.tables["intents"].collect()}
            for name in intents:
                if name not in known:
                    raise UnknownIntentError(name)
        return intents

    def prepare_lengths(self) -> tuple[list[int], tuple[str, ...], str, dict[str, float]]:
        """What entities are looked for by: lengths of dictionary entries, builtin kinds, the language, and the strictness of kinds that match by parts."""
        if self._lengths is None:
            known = entities.entry_lengths(self.tables["entries"])
            self._lengths = [n for n in known if self.config.longest_value is None or n <= self.config.longest_value] or [1]
            held = {r["entity"]: r["strictness"] for r in self.tables["entities"].select("entity", "strictness").collect()}
            used, self._loose = set(held), {kind: s for kind, s in held.items() if s is not None and s < 1 and kind not in entities.BUILTIN_KINDS}
            self._kinds = tuple(k for k in entities.GRAMMAR_KINDS if k in used)
        return self._lengths, self._kinds, self.language, self._loose

    def prepare(self, texts: DataFrame) -> Prepared:
        """The different texts under ids of their own, with the entities found in them; a null text is empty. Texts that many rows have are parsed once, and ids of rows play no part.

        An id is a text's hash. Of texts that share one (of 10 ** 10, some two or three) all but the first get another.
        """
        said = F.coalesce("text", F.lit(""))
        same = texts.groupBy(F.xxhash64(said).alias("h")).agg(F.array_sort(F.collect_set(said)).alias("same"))
        each = same.select("h", F.posexplode_outer("same").alias("n", "text"))
        texts = self._hold(each.select(F.when(F.col("n") == 0, F.col("h")).otherwise(F.xxhash64("h", "n")).alias("id"), "text"))
        matching = self.config.matching()
        stems = None if matching == "plain" else self.resources["stems"]["stems"]
        found = find_entities(texts, self.tables["entries"], *self.prepare_lengths(), matching, self.tables["stemmed"], stems)
        return Prepared(texts, self._hold(found), self.resources, hold=self._hold)

    @staticmethod
    def _for_rows(texts: DataFrame, prepared: Prepared, found: DataFrame) -> DataFrame:
        """What was found for a text, for every row that has it: null and repeated ids are rows like others. Rows of one text are spread by Spark's handling of skewed joins."""
        rows = texts.select(F.col("id").cast("long").alias("__row"), F.coalesce("text", F.lit("")).alias("input"))
        by_text = joins.by_key(found, prepared.texts.withColumnRenamed("text", "input"), "id")
        return joins.by_key(rows, by_text, "input").withColumn("id", F.col("__row")).drop("__row")

    def _resolved(self, prepared: Prepared, chosen: DataFrame) -> DataFrame:
        """id, intent, probability, slots of the chosen (id, intent, probability, unit: its place in the cascade, null for none)."""
        raw = None
        for k, unit in enumerate(self.units):
            own = unit.slots(prepared, chosen.where(F.col("unit") == k).select("id", "intent"))
            raw = own if raw is None else raw.unionByName(own)
        return self._with_slots(prepared, chosen, raw)

    def _with_slots(self, prepared: Prepared, chosen: DataFrame, raw: DataFrame) -> DataFrame:
        extensible = self.tables["entities"].select("entity", F.col("extensible").alias("yes"))
        found = parsers.resolve_slots(raw, prepared.matches, self.tables["entries"], extensible)
        listed = found.groupBy("id", "intent").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end"), "raw_value", "resolved", "entity", "slot_name"))).alias("slots"))
        joined = joins.by_key(chosen, listed, ["id", "intent"], "left")
        return joined.select("id", "intent", "probability", F.coalesce("slots", F.array().cast(f"array<{SLOT}>")).alias("slots"))

    def parse(self, texts: DataFrame, intents: list[str] | None = None) -> DataFrame:
        """id, input, intent (null for none), probability, slots. The first parser that is sure enough of an intent decides; later ones see only the texts that are left."""
        intents = self._scope(intents)
        prepared = self.prepare(texts)
        out = raw = None
        rest = prepared
        for unit in self.units:
            best = classifier.best(unit.candidates(rest, intents)).where(F.col("intent").isNotNull() & (F.col("probability") > unit.threshold))
            own = self._hold(best.select("id", "intent", "probability"))
            held = unit.slots(rest, own)
            rest = rest.only(self._hold(joins.by_key(rest.texts, own, "id", "left_anti").select("id")))
            out, raw = (own, held) if out is None else (out.unionByName(own), raw.unionByName(held))
        none = rest.texts.select("id", F.lit(None).cast("string").alias("intent"), F.lit(1.0).alias("probability"))
        done = self._with_slots(prepared, out.unionByName(none), raw)
        return self._for_rows(texts, prepared, done).select("id", "input", "intent", "probability", "slots")

    def to_json(self, parsed: DataFrame, reference: Column | None = None) -> DataFrame:
        """id, result: each row of `parse` as one JSON object, with slots that say where they are and what they stand for. reference: the instant that dates and times are
        counted from, a column of parsed or a constant; now, if none is given."""
        own = ["__row", "id", "input", "intent", "probability"]
        each = parsed.withColumn("__row", F.monotonically_increasing_id()).select(*own, F.posexplode_outer("slots").alias("n", "x")).select("*", F.col("x.entity").alias("__kind"), F.col("x.raw_value").alias("__raw"), F.col("x.resolved").alias("__resolved"))
        each = entities.resolved_values(each, "__kind", "__raw", "__resolved", self.language, "__value", reference)
        value = F.from_json("__value", VALUE)
        slot = F.struct(F.col("x.raw_value").alias("rawValue"), value.alias("value"), F.struct(F.col("x.start").alias("start"), F.col("x.end").alias("end")).alias("range"), F.col("x.entity").alias("entity"), F.col("x.slot_name").alias("slotName"))
        listed = each.groupBy(*own).agg(F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("n", slot.alias("slot"))))).alias("slots"))
        result = F.struct("input", F.struct(F.col("intent").alias("intentName"), "probability").alias("intent"), F.transform("slots", lambda s: s["slot"]).alias("slots"))
        return listed.select("id", F.to_json(result, {"ignoreNullFields": "false"}).alias("result"))

    def parse_top(self, texts: DataFrame, top_n: int, intents: list[str] | None = None) -> DataFrame:
        """id, rank (from 1), intent, probability, slots of the n best intents over all parsers."""
        if top_n < 1:
            raise ValueError("top_n must be at least 1")
        intents = self._scope(intents)
        prepared, every = self.prepare(texts), None
        for k, unit in enumerate(self.units):
            own = unit.candidates(prepared, intents).where("intent IS NOT NULL").select("id", "intent", "probability", F.lit(k).alias("unit"))
            every = own if every is None else every.unionByName(own)
        every = every.groupBy("id", "intent").agg(F.max("probability").alias("probability"), F.max_by("unit", F.struct("probability", -F.col("unit"))).alias("unit"))
        ranked = self._hold(every.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("probability"), "intent"))).where(F.col("rank") <= top_n))
        done = joins.by_key(self._resolved(prepared, ranked.drop("rank")), ranked.select("id", "intent", "rank"), ["id", "intent"])
        return self._for_rows(texts, prepared, done).select("id", "rank", "intent", "probability", "slots")

    def get_intents(self, texts: DataFrame) -> DataFrame:
        """id, intent, probability of every intent: the best over the parsers."""
        prepared = self.prepare(texts)
        scores = parsers.merge_scores(prepared.texts, self.tables["intents"], *[u.candidates(prepared).where("intent IS NOT NULL") for u in self.units])
        return self._for_rows(texts, prepared, scores).select("id", "intent", "probability")

    def get_slots(self, texts: DataFrame, intent: str) -> DataFrame:
        """id, slots under a given intent: those of the first parser that finds any."""
        self._scope([intent])
        prepared = self.prepare(texts)
        chosen = prepared.texts.select("id", F.lit(intent).alias("intent"), F.lit(1.0).alias("probability"))
        raw, left = None, chosen
        for unit in self.units:
            own = self._hold(unit.slots(prepared, left))
            left = joins.by_key(left, own.select("id").distinct(), "id", "left_anti")
            raw = own if raw is None else raw.unionByName(own)
        return self._for_rows(texts, prepared, self._with_slots(prepared, chosen, raw)).select("id", "slots")

    def save(self, path: str) -> None:
        """Write the model as a folder: a manifest, the shared tables, the resources that units need, and a folder for each unit. An existing folder is an error."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            raise ExistsError(path)
        for name, df in self.tables.items():
            df.coalesce(1).write.parquet(f"{path}/shared/{name}")
        for kind, named in self.resources.items():
            for name, df in named.items():
                df.coalesce(1).write.parquet(f"{path}/resources/{kind}/{name}")
        for k, unit in enumerate(self.units):
            unit.save(f"{path}/units/{k}_{unit.config.unit}")
        needed = {kind: sorted(named) for kind, named in self.resources.items()}
        manifest = json.dumps({"version": __version__, "language": self.language, "resources": needed, "config": json.loads(self.config.to_json())})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str, any_version: bool = False) -> IntentEngineModel:
        manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
        if manifest["version"] != __version__ and not any_version:
            raise VersionError(manifest["version"], __version__)
        config = EngineConfig.from_json(json.dumps(manifest["config"]))
        tables = {name: spark.read.schema(schema).parquet(f"{path}/shared/{name}") for name, schema in SHARED.items()}
        resources = {kind: {n: spark.read.schema(RESOURCE[kind]).parquet(f"{path}/resources/{kind}/{n}") for n in names} for kind, names in manifest["resources"].items()}
        units = [PARSERS.by_name(p.unit)(p).load(spark, f"{path}/units/{k}_{p.unit}") for k, p in enumerate(config.parsers)]
        return cls(spark, config, manifest["language"], tables, units, resources)
