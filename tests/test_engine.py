"""The engine end to end, its units, saved and loaded, on a stream, and its metrics."""

import json

import pytest
from pyspark.sql import functions as F

from parlance import cli
from parlance.errors import DatasetError, ExistsError, MissingResourceError, NotFittedError, RegistryError, UnknownIntentError
from parlance.operators import classifier, crf
from parlance.operators.token_features import TOKEN_FEATURES, FeatureConfig, feature
from parlance.plans import evaluation, units
from parlance.plans.config import ClassifierConfig, EngineConfig, KeywordConfig, LookupConfig, PatternConfig, ProbabilisticConfig, SlotFillerConfig, UnitConfig
from parlance.plans.engine import IntentEngine, IntentEngineModel
from parlance.plans.plugins import ENTITY_PARSERS, PARSERS, IntentParser
from parlance.sources.dataset import Dataset
from parlance.streaming.parse import entity_stream, parse_stream
from parlance.streaming.windows import counts_by_window

YAML = """
type: intent
name: waterBeds
slots: [{name: bed, entity: plot}, {name: span, entity: duration}]
utterances:
  - sprinkle the [bed](tomato bed) now
  - water the [bed](herb spiral) for [span](20 minutes)
  - run the hose on my [bed](tomato bed) for [span](3 hours)
  - the [bed](orchard) looks dry
  - give [bed](herb spiral) a good soak
---
type: intent
name: logHarvest
slots: [{name: crop, entity: crop}, {name: weight, entity: number}, {name: bed, entity: plot}]
utterances:
  - we picked [weight](12) kilos of [crop](courgettes) from the [bed](orchard)
  - log [weight](7) kilos of [crop](plums)
  - harvest of [crop](plums) is [weight](30) kilos
  - write down [weight](4.5) kilos of [crop](runner beans)
  - basket of [crop](courgettes) came in
---
type: entity
name: plot
automatically_extensible: false
matching_strictness: 0.6
values: [tomato bed, [herb spiral, herb corner], orchard, old walled garden behind the north barn]
---
type: entity
name: crop
values: [[courgettes, zucchini], plums, runner beans]
"""
FAST = ProbabilisticConfig(classifier=ClassifierConfig(noise_factor=2), slot_filler=SlotFillerConfig(min_utterances=24))
FULL = EngineConfig((LookupConfig(), PatternConfig(), FAST))


def texts_of(spark, *said):
    return spark.createDataFrame(list(enumerate(said)), "id long, text string")


def parsed(model, texts, **more):
    out = {r["id"]: r for r in model.parse(texts, **more).collect()}
    model.release()
    return out


def slots(row):
    return [(s["slot_name"], s["raw_value"], s["resolved"]) for s in row["slots"]]


@pytest.fixture(scope="module")
def dataset():
    return Dataset.from_yaml("en", YAML)


@pytest.fixture(scope="module")
def model(spark, dataset):
    return IntentEngine(spark, FULL).fit(dataset)


def test_engine(spark, model, dataset, tmp_path):
    texts = texts_of(spark, "Sprinkle the herb corner now", "please could you water the orchard for 45 minutes or so", "", None, "sprinkle the old walled garden behind the north barn now", "we picked 9 kilos of zucchini today")
    got = parsed(model, texts)
    assert (got[0]["intent"], got[0]["probability"]) == ("waterBeds", 1.0) and slots(got[0]) == [("bed", "herb corner", "herb spiral")]
    assert got[1]["intent"] == "waterBeds" and ("bed", "orchard", "orchard") in slots(got[1])
    assert got[2]["intent"] is None and got[3]["intent"] is None and len(got) == 6
    assert slots(got[4]) == [("bed", "old walled garden behind the north barn", "old walled garden behind the north barn")]
    assert got[5]["intent"] == "logHarvest" and ("weight", "9", "9") in slots(got[5])
    with pytest.raises(UnknownIntentError):
        model.parse(texts, ["other"])
    path = str(tmp_path / "model")
    model.save(path)
    with pytest.raises(ExistsError):
        model.save(path)
    loaded = IntentEngineModel.load(spark, path)
    assert {i: (r["intent"], slots(r)) for i, r in parsed(loaded, texts).items()} == {i: (r["intent"], slots(r)) for i, r in got.items()}
    texts.where("id = 0").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    entity_stream(stream, loaded).writeStream.format("memory").queryName("found").trigger(availableNow=True).start().awaitTermination()
    assert ("plot", "herb spiral") in {(r["kind"], r["resolved"]) for r in spark.table("found").collect()}
    parse_stream(stream, loaded, str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert [r["intent"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["waterBeds"]


def test_null_and_repeated_ids_and_texts(spark, model):
    """Every row comes back with what its own text says, whatever its id, and as often as it is there."""
    rows = [(None, "the orchard looks dry"), (1, "the orchard looks dry"), (1, "log 3 kilos of plums"), (1, "log 3 kilos of plums"), (2, None), (2, "")]
    texts = spark.createDataFrame(rows, "id long, text string")
    want = {"the orchard looks dry": ("waterBeds", ["orchard"]), "log 3 kilos of plums": ("logHarvest", ["3", "plums"])}
    done = model.parse(texts).collect()
    assert sorted((r["id"] or 0, r["input"], r["intent"], [s["raw_value"] for s in r["slots"]]) for r in done) == sorted((i or 0, t or "", *want.get(t or "", (None, []))) for i, t in rows)
    said = [json.loads(r["result"]) for r in model.to_json(model.parse(texts)).collect()]
    assert sorted((s["input"], len(s["slots"])) for s in said) == sorted((t or "", len(want.get(t or "", ("", []))[1])) for _, t in rows)
    top = model.parse_top(texts, 1).collect()
    assert sorted((r["id"] or 0, r["intent"]) for r in top if r["id"] != 2) == [(0, "waterBeds"), (1, "logHarvest"), (1, "logHarvest"), (1, "waterBeds")]
    assert len(model.get_intents(texts).collect()) == 2 * len(rows)
    assert sorted((r["id"] or 0, len(r["slots"])) for r in model.get_slots(texts, "waterBeds").collect() if r["slots"]) == [(0, 1), (1, 1)]
    model.release()


def test_values_match_with_words_left_out(spark, model):
    got = parsed(model, texts_of(spark, "sprinkle the old garden behind the barn now", "sprinkle the walled barn now"))
    assert slots(got[0]) == [("bed", "old garden behind the barn", "old walled garden behind the north barn")]
    assert got[1]["intent"] != "waterBeds" or ("bed", "walled barn", "old walled garden behind the north barn") not in slots(got[1])


def test_top_intents_and_slots_of_an_intent(spark, model):
    texts = texts_of(spark, "log 3 kilos of plums", "the orchard looks dry")
    ranked = model.parse_top(texts, 2).collect()
    assert {(r["id"], r["rank"]) for r in ranked} == {(0, 1), (0, 2), (1, 1), (1, 2)}
    assert {r["id"]: r["intent"] for r in ranked if r["rank"] == 1} == {0: "logHarvest", 1: "waterBeds"}
    every = model.get_intents(texts).collect()
    assert len(every) == 4 and all(0 <= r["probability"] <= 1 for r in every)
    under = {r["id"]: slots(r) for r in model.get_slots(texts, "logHarvest").collect()}
    assert under[0] == [("weight", "3", "3"), ("crop", "plums", "plums")]
    with pytest.raises(ValueError):
        model.parse_top(texts, 0)
    model.release()


def test_lookup_reads_any_subset_of_entities(spark, dataset):
    """A carrier phrase that holds an entity's value itself, and more entities than all subsets of could be tried."""
    data = Dataset.from_yaml("en", YAML + "\n---\ntype: intent\nname: orchardNews\nutterances: [any news of the orchard and the plums, 'tell me 1 2 3 4 5 6 7 8 9 10 11 12 13 14 about [crop](plums)']\n")
    lookup = IntentEngine(spark, EngineConfig((LookupConfig(),))).fit(data)
    got = parsed(lookup, texts_of(spark, "any news of the orchard and the plums", "tell me 1 2 3 4 5 6 7 8 9 10 11 12 13 14 about zucchini", "any news of the orchard and the zucchini"))
    assert [got[i]["intent"] for i in range(3)] == ["orchardNews", "orchardNews", None]
    assert slots(got[0]) == [] and slots(got[1]) == [("crop", "zucchini", "courgettes")]


def test_patterns_give_slots_and_stop_words_are_ignored(spark, dataset):
    texts = texts_of(spark, "log, 8 kilos: of runner beans.", "please log 8 kilos of the plums for me", "log 8 of plums")
    strict = parsed(IntentEngine(spark, EngineConfig((PatternConfig(),))).fit(dataset), texts)
    assert slots(strict[0]) == [("weight", "8", "8"), ("crop", "runner beans", "runner beans")] and strict[1]["intent"] is None and strict[2]["intent"] is None
    for config in (PatternConfig(ignore_stop_words=True), LookupConfig(ignore_stop_words=True)):
        loose = parsed(IntentEngine(spark, EngineConfig((config,))).fit(dataset), texts)
        assert slots(loose[1]) == [("weight", "8", "8"), ("crop", "plums", "plums")] and loose[2]["intent"] is None


def test_loose_matches_of_an_entity(spark, model):
    got = parsed(model, texts_of(spark, "sprinkle the walled garden behind the north barn now", "sprinkle the north barn now"))
    assert slots(got[0]) == [("bed", "walled garden behind the north barn", "old walled garden behind the north barn")]
    assert all(s[0] != "bed" for s in slots(got[1]))


def test_plug_ins_and_keywords(spark, dataset):
    @PARSERS.register("shouting", override=True)
    class Shouting(IntentParser):
        schemas = {"intents": "intent string"}

        def fit(self, training):
            self.tables = {"intents": training.texts.select("intent").distinct().limit(1)}
            return self

        def candidates(self, prepared, intents=None):
            loud = prepared.texts.where((F.col("text") == F.upper("text")) & F.col("text").rlike(r"\p{Lu}"))
            return loud.crossJoin(self.checked().tables["intents"]).select("id", "intent", F.lit(1.0).alias("probability"))

        def slots(self, prepared, chosen):
            return spark.createDataFrame([], "id long, intent string, slot_name string, entity string, s long, e long, raw_value string")

    config = EngineConfig.from_json(json.dumps({"parsers": [{"unit": "shouting"}, {"unit": "probabilistic", "classifier": {"noise_factor": 2}, "slot_filler": {"unit": "keyword", "lowercase": True, "keywords": {"waterBeds": {"bed": {"orchard": "plot"}}}}}]}))
    assert config == EngineConfig.from_json(config.to_json()) and isinstance(config.parsers[1].slot_filler, KeywordConfig)
    model = IntentEngine(spark, config).fit(dataset)
    got = parsed(model, texts_of(spark, "HELLO THERE", "the ORCHARD looks dry"))
    assert got[0]["intent"] is not None and got[1]["intent"] == "waterBeds" and slots(got[1]) == [("bed", "ORCHARD", "orchard")]
    assert PARSERS.name_of(Shouting) == "shouting" and "lookup" in PARSERS.names()
    with pytest.raises(RegistryError):
        EngineConfig.from_json('{"parsers": [{"unit": "nothing"}]}')
    with pytest.raises(RegistryError):
        PARSERS.register("shouting")(Shouting)
    with pytest.raises(ValueError):
        EngineConfig.from_json('{"parsers": [{"unit": "lookup", "colour": 1}]}')


def test_units_by_themselves(spark, model, tmp_path):
    lookup, _, probabilistic = model.units
    with pytest.raises(NotFittedError):
        units.LookupParser(LookupConfig()).checked()
    again = units.LookupParser(LookupConfig()).from_bytes(spark, lookup.to_bytes())
    assert sorted(map(str, again.tables["models"].collect())) == sorted(map(str, lookup.tables["models"].collect()))
    probabilistic.save(str(tmp_path / "unit"))
    loaded = units.load_unit(spark, str(tmp_path / "unit"))
    assert isinstance(loaded, units.ProbabilisticParser) and loaded.config == FAST
    assert loaded.fitted and loaded.classifier.model.weights.count() == probabilistic.classifier.model.weights.count()
    prepared = model.prepare(texts_of(spark, "the orchard looks dry"))
    top = probabilistic.classifier.model.top_features(5).collect()
    assert {r["rank"] for r in top} == set(range(1, 6))
    assert probabilistic.classifier.model.top_activations(probabilistic.classifier.terms(prepared), 3).count() >= 3
    chain = probabilistic.slot_filler.tables["chain"]
    assert crf.weight_report(chain, 3).count() == 12 and crf.transitions(chain, "O").count() > 0 and crf.transitions(chain, "O", incoming=False).count() > 0
    assert crf.state_weights(chain, chain.where("feature IS NOT NULL").first()["feature"]).count() >= 1
    model.release()


def test_counts_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = sorted(map(tuple, counts_by_window(events, "ts", "event_type", "1 day", "1 hour").collect()))
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    counts_by_window(stream, "ts", "event_type", "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == want and want


def test_entity_parsers(spark, dataset, tmp_path):
    training = IntentEngine(spark).training(dataset)
    texts = texts_of(spark, "zucchini in the orchard for 2 hours", None)
    for name, want, some in (("custom_entities", {("crop", "courgettes"), ("plot", "orchard")}, ["plot"]), ("builtin_entities", {("number", "2"), ("duration", "2 hours")}, ["duration"])):
        parser = ENTITY_PARSERS.by_name(name)(UnitConfig(name)).fit(training)
        parser.save(str(tmp_path / name))
        loaded = units.load_unit(spark, str(tmp_path / name))
        assert {(r["kind"], r["resolved"]) for r in loaded.parse(texts).collect()} == want
        assert {r["kind"] for r in loaded.parse(texts, some).collect()} == set(some)
        with pytest.raises(ValueError):
            loaded.parse(texts, ["other"])


def test_resources_and_configured_features(spark, dataset):
    @feature("vowels") if "vowels" not in TOKEN_FEATURES.names() else (lambda f: f)
    def vowels(t):
        return F.length(F.regexp_replace(t.of("norm"), "[^aeiou]", "")).cast("string")

    held = {
        "stems": {"stems": spark.createDataFrame([("picked", "pick"), ("looks", "look")], "form string, stem string")},
        "word_clusters": {"garden": spark.createDataFrame([("plums", "fruit"), ("courgettes", "vegetable")], "word string, cluster string")},
        "gazetteers": {"common": spark.createDataFrame([("the",), ("of",), ("kilos",)], "value string")},
        "stop_words": {"stop_words": spark.createDataFrame([("the",), ("of",)], "word string")},
        "noise": {"noise": spark.createDataFrame([(0, "lorem"), (1, "ipsum")], "ord long, word string")},
    }
    features = (FeatureConfig("ngram", {"n": 1, "use_stemming": True}, (-1, 0, 1)), FeatureConfig("ngram", {"n": 2, "common_words_gazetteer_name": "common"}), FeatureConfig("word_cluster", {"cluster_name": "garden"}), FeatureConfig("length"), FeatureConfig("vowels"), FeatureConfig("shape_ngram", {"n": 2}, (-1,)), FeatureConfig("entity_match"), FeatureConfig("builtin_entity_match", drop_out=0.2))
    how = classifier.Featurizer(use_stemming=True, word_clusters_name="garden", filter_stop_words=True, keep_order=False)
    config = EngineConfig((ProbabilisticConfig(classifier=ClassifierConfig(noise_factor=2, unknown_word_prob=0.3, featurizer=how), slot_filler=SlotFillerConfig(min_utterances=24, tagging_scheme="BILOU", features=features)),))
    assert config.resources() == {"stems": {"stems"}, "word_clusters": {"garden"}, "gazetteers": {"common"}, "stop_words": {"stop_words"}}
    model = IntentEngine(spark, config, held).fit(dataset)
    got = parsed(model, texts_of(spark, "harvest of plums is 6 kilos"))
    assert got[0]["intent"] == "logHarvest" and ("crop", "plums", "plums") in slots(got[0])
    names = {r["feature"].split("=")[0] for r in model.units[0].slot_filler.tables["chain"].where("feature IS NOT NULL").select("feature").collect()}
    assert {"ngram_1_True", "ngram_1_True[-1]", "ngram_common_2", "word_cluster_garden", "vowels", "shape_ngram_2[-1]", "entity_match", "builtin_entity_match"} <= names
    with pytest.raises(MissingResourceError):
        IntentEngine(spark, config).fit(dataset)


def test_metrics_and_command_line(spark, dataset, tmp_path, monkeypatch, capsys):
    patterns = EngineConfig((LookupConfig(), PatternConfig()))
    report = evaluation.cross_validate(spark, dataset, evaluation.engine_fit(spark, patterns), folds=2)
    assert sum(r["n"] for r in report.confusion.collect()) == 10 and report.errors.count() == report.confusion.where("actual <> predicted").agg(F.sum("n")).first()[0]
    same = evaluation.train_test(spark, dataset, dataset, evaluation.engine_fit(spark, patterns))
    assert all(r["f1"] == 1.0 for r in same.intents.collect()) and all(r["f1"] == 1.0 for r in same.slots.collect()) and same.errors.count() == 0
    with pytest.raises(DatasetError):
        evaluation.cross_validate(spark, dataset, folds=50)
    monkeypatch.setattr("parlance.session.build_session", lambda *a, **k: spark)
    (tmp_path / "d.yaml").write_text(YAML)
    assert cli.main(["generate-dataset", "en", str(tmp_path / "d.yaml")]) == 0
    (tmp_path / "d.json").write_text(capsys.readouterr().out)
    (tmp_path / "c.json").write_text(patterns.to_json())
    assert cli.main(["train", str(tmp_path / "d.json"), str(tmp_path / "m"), "--config", str(tmp_path / "c.json")]) == 0
    assert cli.main(["parse", str(tmp_path / "m"), "-q", "log 2 kilos of plums"]) == 0
    result = json.loads(capsys.readouterr().out)
    assert result["intent"] == {"intentName": "logHarvest", "probability": 1.0} and result["input"] == "log 2 kilos of plums"
    assert result["slots"][0] == {"rawValue": "2", "value": {"kind": "Number", "value": "2", "unit": None}, "range": {"start": 4, "end": 5}, "entity": "number", "slotName": "weight"}
    assert result["slots"][1]["value"] == {"kind": "Custom", "value": "plums", "unit": None}
    assert cli.main(["train-test-metrics", str(tmp_path / "d.json"), str(tmp_path / "d.json"), str(tmp_path / "r.json"), "-c", str(tmp_path / "c.json"), "-i"]) == 0
    shown = json.loads((tmp_path / "r.json").read_text())
    assert shown["metrics"]["waterBeds"]["intent"]["f1"] == 1.0 and shown["metrics"]["logHarvest"]["slots"]["crop"]["f1"] == 1.0 and shown["parsing_errors"] == []
