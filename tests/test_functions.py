"""Goldens of text functions, datasets, parsers, tags and models."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.errors import DatasetError, ExistsError, MissingResourceError, RegistryError
from parlance.functions import numbers, text
from parlance.operators import classifier, crf, entities, parsers, sampling, tagging, variations
from parlance.plans.config import EngineConfig, PatternConfig
from parlance.plans.plugins import Registry
from parlance.sources import resources
from parlance.sources.dataset import Dataset, parse_annotation

YAML = """
type: intent
name: openValve
slots: [{name: tank, entity: tank}]
utterances: ["open the [tank](cistern) valve", "let [tank] run", " "]
---
type: entity
name: tank
automatically_extensible: no
values: [cistern, [rain barrel, butt]]
"""


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("said", "want"), [("", []), ("  ", []), ("$$ % !!", ["$", "$", "%", "!", "!"]), ("Küche_1, l’eau - ok?", ["Küche_1", "l", "eau", "ok", "?"])])
def test_tokens(spark, said, want):
    assert one(spark, text.tokenize_light(F.lit(said))) == want
    rows = text.tokens(spark.createDataFrame([(1, said)], "id long, text string"), ["id"]).orderBy("i").collect()
    assert [r["value"] for r in rows] == want and all(said[r["s"] : r["e"]] == r["value"] for r in rows)


def test_null_text_has_no_tokens(spark):
    assert text.tokens(spark.createDataFrame([(1, None)], "id long, text string"), ["id"]).count() == 0


@pytest.mark.parametrize(("word", "want"), [("abc", "xxx"), ("Abc", "Xxx"), ("ABC", "XXX"), ("aBc", "xX")])
def test_shapes(spark, word, want):
    assert one(spark, text.shape(F.lit(word))) == want


@pytest.mark.parametrize("n", [0, 7, 13, 20, 23, 100, 101, 999, 1000, 1060, 2500, 9999])
def test_number_words(spark, n):
    assert one(spark, numbers.word_column(F.lit(n))) == numbers.words(n)


def test_number_words_by_name():
    assert (numbers.words(23), numbers.words(1060)) == ("twenty-three", "one thousand and sixty")


def test_annotations():
    got = [(c.text, c.slot, c.entity) for c in parse_annotation("play [song:track](hey) by [who]")]
    assert got == [("play ", None, None), ("hey", "song", "track"), (" by ", None, None), (None, "who", None)]
    for bad in ("a [b", "a [b](c"):
        with pytest.raises(DatasetError):
            parse_annotation(bad)


def test_dataset_round_trip_and_rules():
    d = Dataset.from_yaml("en", YAML).validate()
    assert d.intents["openValve"][1][1].text == "cistern" and len(d.intents["openValve"]) == 2
    assert d.intent_form("openValve")["utterances"][0]["data"][1] == {"text": "cistern", "slot_name": "tank", "entity": "tank"} and d.entity_form("tank")["data"][1] == {"value": "rain barrel", "synonyms": ["butt"]}
    timed = Dataset.from_yaml("en", YAML.replace("[tank](cistern) valve", "valve for [span:duration](2 hours)"))
    assert "duration" in timed.entities and timed.entity_form("duration") == {}
    plain = timed.without_builtin_slots()
    assert "duration" not in plain.entities and [c.slot for c in plain.intents["openValve"][0]] == [None, None]
    assert json.loads(Dataset.from_json(d.to_json()).validate().to_json()) == json.loads(d.to_json())
    with pytest.raises(DatasetError):
        Dataset("xx", {}, {}).validate()
    with pytest.raises(DatasetError):
        Dataset.from_yaml("en", "type: other\nname: x\n")


def test_overlaps_and_placeholders(spark):
    texts = spark.createDataFrame([(1, "the song kid loco by him"), (2, "nothing")], "id long, text string")
    found = spark.createDataFrame([(1, "track", 4, 17, "song kid loco"), (1, "artist", 9, 17, "kid loco"), (1, "number", 21, 24, "him")], "id long, kind string, s long, e long, value string")
    kept = entities.keep_longest(found, ["id"])
    assert {r["kind"] for r in kept.collect()} == {"track", "number"}
    rewritten, ranges = entities.replace_with_placeholders(texts, kept, ["id"])
    assert {r["id"]: r["rewritten"] for r in rewritten.collect()} == {1: "the %TRACK% by %NUMBER%", 2: "nothing"}
    new = {r["kind"]: (r["new_s"], r["new_e"]) for r in ranges.collect()}
    assert new == {"track": (4, 11), "number": (15, 23)}


def test_builtins(spark):
    said = "pay $12.50 or 5% on the 3rd by 2024-05-06 at 20 degrees for 2 weeks"
    got = {(r["kind"], r["value"], r["number"]) for r in entities.builtin_matches(spark.createDataFrame([(1, said)], "id long, text string"), ["id"]).collect()}
    assert {("amountOfMoney", "$12.50", 12.5), ("percentage", "5%", 5.0), ("ordinal", "3rd", 3.0), ("date", "2024-05-06", None), ("temperature", "20 degrees", 20.0), ("duration", "2 weeks", 2.0), ("number", "12.50", 12.5)} <= got


@pytest.mark.parametrize("scheme", tagging.SCHEMES)
def test_tags_round_trip(spark, scheme):
    toks = text.tokens(spark.createDataFrame([(1, "a b c d e f g")], "id long, text string"), ["id"])
    spans = spark.createDataFrame([(1, "x", 0, 3), (1, "y", 8, 9)], "id long, slot_name string, s long, e long")
    tags = tagging.encode(toks, spans, ["id"], scheme)
    assert sorted(map(tuple, tagging.decode(tags, ["id"], scheme).collect())) == [(1, "x", 0, 3), (1, "y", 8, 9)]
    with pytest.raises(ValueError):
        tagging.encode(toks, spans, ["id"], "other")


def test_ambiguous_keys_are_left_out(spark):
    trained = spark.createDataFrame([(1, "a", "do %X%"), (2, "b", "do %X%"), (3, "a", "go %X%")], "id long, intent string, rewritten string")
    slots = spark.createDataFrame([(i, 0, "s") for i in (1, 2, 3)], "id long, n long, slot_name string")
    assert [r["key"] for r in parsers.build_lookup(trained, slots).collect()] == ["go % x %"]
    assert [(r["intent"], r["ord"], r["slot_names"]) for r in parsers.build_patterns(trained, slots).collect()] == [("a", 0, ["s"])]


def test_cascade_and_ranking(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    a = spark.createDataFrame([(1, "x", 1.0)], "id long, intent string, probability double")
    b = spark.createDataFrame([(1, "y", 0.9), (2, "y", 0.8)], "id long, intent string, probability double")
    assert sorted((r["id"], r["intent"]) for r in parsers.cascade(ids, a, b).collect()) == [(1, "x"), (2, "y"), (3, None)]
    with pytest.raises(ValueError):
        parsers.reweight(a.withColumn("n_slots", F.lit(1)), 0)


def test_synonyms(spark):
    values = spark.createDataFrame([("e", 0, "oak", ["elm"]), ("e", 1, "elm", []), ("e", 2, "ash", ["oak", "rowan"])], "entity string, ord long, value string, synonyms array<string>")
    assert {(r["surface"], r["resolved"]) for r in variations.synonym_surfaces(values).collect()} == {("oak", "oak"), ("elm", "elm"), ("ash", "ash"), ("rowan", "ash")}


def test_variations(spark):
    assert set(one(spark, variations.punctuation_variations(F.lit("a.b-c")))) == {"a.b-c", "ab-c", "a.bc", "abc"}
    assert set(one(spark, variations.and_variations(F.lit("salt and pepper")))) == {"salt and pepper", "salt & pepper"}
    assert "twenty-three apples" in one(spark, variations.number_variations(F.lit("23 apples")))
    assert one(spark, variations.punctuation_variations(F.lit("a.b.c.d.e"))) == []


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("label"))
    f = lambda df: sorted(map(tuple, sampling.folds(df, "k", "label", 5, 1).collect()))
    assert f(rows.repartition(1)) == f(rows.repartition(7))


def test_chain_learns_and_its_probabilities_sum_to_one(spark):
    said = [([["w=to"], ["w=paris" if k else "w=rome"], ["w=now"]], ["O", "B-city", "O"]) for k in (0, 1)] * 6
    rows = [("fly", n, [(i, i, i + 1, f) for i, f in enumerate(feats)], tags) for n, (feats, tags) in enumerate(said)]
    rows = spark.createDataFrame(rows, "intent string, id long, tokens array<struct<i:long,s:long,e:long,features:array<string>>>, tags array<string>")
    tagger = crf.taggers(crf.fit(rows).collect())["fly"]
    assert tagger.tag([["w=to"], ["w=rome"], ["w=now"]]) == ["O", "B-city", "O"]
    feats = [["w=to"], ["w=rome"]]
    assert sum(tagger.probability(feats, [a, b]) for a in tagger.tags for b in tagger.tags) == pytest.approx(1)
    assert tagger.tag([]) == [] and tagger.probability([], []) == 1.0


def test_one_vs_rest_separates(spark):
    rows = [(k % 2, 0.05, [k % 2], [1.0]) for k in range(20)]
    w, b = classifier.train_one_vs_rest(spark.createDataFrame(rows, "label long, weight double, places array<long>, values array<double>"), 2, 2, 0.001)
    assert w[0, 0] + b[0] > 0 > w[0, 1] + b[0]


def test_config_and_registry():
    config = EngineConfig(parsers=(PatternConfig(max_queries=3),), seed=4)
    assert EngineConfig.from_json(config.to_json()) == config
    with pytest.raises(ValueError):
        EngineConfig.from_json('{"sed": 1}')
    registry = Registry("thing")
    registry.register("a")(int)
    assert registry.by_name("a") is int and registry.name_of(int) == "a" and registry.names() == ["a"]
    for bad in (lambda: registry.register("a")(str), lambda: registry.by_name("b"), lambda: registry.name_of(str)):
        with pytest.raises(RegistryError):
            bad()


def test_resources(spark, tmp_path):
    for kind, name, content in (("stop_words", "s", "the\n a \nthe\n"), ("noise", "n", "one two\nthree"), ("stems", "t", "go,went,gone\n"), ("word_clusters", "c", "cat\t1\ndog\t2\n"), ("gazetteers", "g", "x\ny\n")):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / f"{name}.txt").write_text(content)
    (tmp_path / "metadata.json").write_text(json.dumps({"stop_words": ["s"], "noise": ["n"], "stems": ["t"], "word_clusters": ["c"], "gazetteers": ["g"]}))
    got = resources.load(spark, str(tmp_path))
    assert {r["word"] for r in got["stop_words"]["s"].collect()} == {"the", "a"}
    assert [r["word"] for r in got["noise"]["n"].orderBy("ord").collect()] == ["one", "two", "three"]
    assert {(r["form"], r["stem"]) for r in got["stems"]["t"].collect()} == {("went", "go"), ("gone", "go")}
    resources.save_text(got, str(tmp_path / "text"))
    again = resources.load(spark, str(tmp_path / "text"), {"stems": ["t"], "word_clusters": ["c"], "noise": ["n"]})
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert all(rows(again[k][n]) == rows(got[k][n]) for k, n in (("stems", "t"), ("word_clusters", "c"), ("noise", "n")))
    with pytest.raises(ExistsError):
        resources.save_text(got, str(tmp_path / "text"))
    packed = shutil.make_archive(str(tmp_path / "en-1.0"), "zip", tmp_path / "text")
    folder = resources.fetch(f"file://{packed}", str(tmp_path / "fetched"))
    resources.link(folder, str(tmp_path / "links/en"))
    assert resources.load(spark, str(tmp_path / "links/en"), {"gazetteers": ["g"]})["gazetteers"]["g"].count() == 2
    for bad in (lambda: resources.fetch(f"file://{packed}", str(tmp_path / "fetched")), lambda: resources.link(folder, str(tmp_path / "links/en"))):
        with pytest.raises(ExistsError):
            bad()
    with pytest.raises(MissingResourceError):
        resources.load(spark, str(tmp_path), {"stems": ["other"]})
    resources.save(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/word_clusters/c")).count() == 2
