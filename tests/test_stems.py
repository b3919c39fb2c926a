"""Dictionary values by forms, by stems, and by either, against plain readings; and in the engine, saved and loaded."""

import random
import re

import pytest

from parlance.errors import MissingResourceError
from parlance.operators import entities
from parlance.operators.classifier import Featurizer
from parlance.plans.config import ClassifierConfig, EngineConfig, KeywordConfig, LookupConfig, PatternConfig, ProbabilisticConfig, UnitConfig
from parlance.plans.engine import IntentEngine, IntentEngineModel
from parlance.plans.units import CustomEntityParser, find_entities, load_unit
from parlance.sources.dataset import Dataset

STEMS = {"beds": "bed", "bedding": "bed", "plums": "plum", "watering": "water", "waters": "water", "cans": "can"}
ENTRIES = [("plot", "bed", 1, "BED"), ("plot", "beds north", 2, "NORTH"), ("plot", "bedding", 1, "BEDDING"), ("tool", "watering can", 2, "CAN"), ("tool", "plums", 1, "PLUMS"), ("tool", "plum", 1, "PLUM")]
SCHEMA = "kind string, norm string, n_tokens int, resolved string"
YAML = """
type: intent
name: fetchTool
slots: [{name: tool, entity: tool}]
utterances: ["bring the [tool](watering can)", "fetch my [tool](garden rake) now"]
---
type: entity
name: tool
automatically_extensible: false
values: [[watering can, sprinkler], garden rake]
"""


def stem(word):
    return STEMS.get(word, word)


def tables(spark):
    stems = spark.createDataFrame([*STEMS.items(), ("beds", "zzz")], "form string, stem string")  # of a form's stems the first one
    entries = spark.createDataFrame(ENTRIES, SCHEMA)
    return entries, entities.stem_entries(entries, stems), stems


def plain(said, matching):
    """Every run of tokens that is an entry by its forms, or else by its stems."""
    own = {(k, n): r for k, n, _, r in ENTRIES}
    by_stem = {}
    for k, n, _, r in ENTRIES:
        key = (k, " ".join(map(stem, n.split())))
        by_stem[key] = min(r, by_stem.get(key, r))
    toks, out = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", said)], []
    for a in range(len(toks)):
        for b in range(a + 1, len(toks) + 1):
            run = [t[0] for t in toks[a:b]]
            for kind in ("plot", "tool"):
                form, stems = own.get((kind, " ".join(run))), by_stem.get((kind, " ".join(map(stem, run))))
                found = {"plain": form, "stemmed": stems, "both": form or stems}[matching]
                if found:
                    s, e = toks[a][1], toks[b - 1][2]
                    out.append((kind, s, e, said[s:e], found))
    return out


@pytest.mark.parametrize("matching", ["plain", "stemmed", "both"])
def test_matches_equal_a_plain_reading(spark, matching):
    rng = random.Random(2)
    words = [*STEMS, "bed", "north", "can", "water", "plum", "the", "Beds", "WATERING"]
    said = ["", None, "!!", "bed  north", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)), "beds " * 300]
    entries, stemmed, stems = tables(spark)
    texts = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    rows = find_entities(texts, entries, None, (), matching=matching, stemmed=stemmed, stems=stems).collect()
    got = sorted((r["id"], r["kind"], r["s"], r["e"], r["value"], r["resolved"]) for r in rows)
    assert got == sorted((i, *m) for i, t in enumerate(said) for m in plain(t or "", matching))


def test_parts_of_entries_match_by_stems(spark):
    entries = spark.createDataFrame([("tool", "old watering can", 3, "CAN")], SCHEMA)
    stems = spark.createDataFrame(list(STEMS.items()), "form string, stem string")
    texts = spark.createDataFrame([(1, "two waters cans here"), (2, "old one"), (3, "waters")], "id long, text string")
    rows = find_entities(texts, entries, None, (), loose={"tool": 0.6}, matching="both", stemmed=entities.stem_entries(entries, stems), stems=stems).collect()
    assert [(r["id"], r["s"], r["e"], r["value"], r["resolved"]) for r in rows] == [(1, 4, 15, "waters cans", "CAN")]


def test_frequent_words_of_a_dictionary(spark):
    """As many as the share of its different words says, the most frequent ones, ties by name; none of a small dictionary."""
    rows = [("a", f"the {chr(97 + n % 26)}{n} of", 3, "x") for n in range(38)] + [("b", "the end", 2, "y")]
    found = lambda share: sorted((r["kind"], r["word"]) for r in entities.frequent_words(spark.createDataFrame(rows, SCHEMA), share).collect())
    assert found(0.05) == [("a", "of"), ("a", "the")] and found(0.075) == [("a", "a0"), ("a", "of"), ("a", "the")] and found(0.001) == []
    with pytest.raises(ValueError):
        found(1.0)


def test_matching_follows_what_units_read():
    by_stem = ClassifierConfig(featurizer=Featurizer(use_stemming=True))
    keyword = KeywordConfig()
    assert EngineConfig().matching() == "plain" and EngineConfig((LookupConfig(),), entity_matching="both").matching() == "both"
    assert EngineConfig((LookupConfig(), ProbabilisticConfig(classifier=by_stem, slot_filler=keyword))).matching() == "both"
    assert EngineConfig((LookupConfig(),), entity_matching="stemmed").resources() == {"stems": {"stems"}}
    with pytest.raises(ValueError):
        EngineConfig(entity_matching="roots").matching()


def test_engine_and_parser_by_stems(spark, tmp_path):
    dataset = Dataset.from_yaml("en", YAML)
    stems = {"stems": {"stems": spark.createDataFrame([("cans", "can"), ("waters", "water"), ("watering", "water"), ("rakes", "rake")], "form string, stem string")}}
    config = EngineConfig((LookupConfig(), PatternConfig()), entity_matching="both")
    with pytest.raises(MissingResourceError):
        IntentEngine(spark, config).fit(dataset)
    engine = IntentEngine(spark, config, stems)
    model = engine.fit(dataset)
    model.save(str(tmp_path / "model"))
    texts = spark.createDataFrame([(1, "bring the waters cans"), (2, "fetch my Garden Rakes now"), (3, "bring the sprinkler"), (4, "bring the hose")], "id long, text string")
    for own in (model, IntentEngineModel.load(spark, str(tmp_path / "model"))):
        got = {r["id"]: [(s["raw_value"], s["resolved"]) for s in r["slots"]] for r in own.parse(texts).collect()}
        assert got == {1: [("waters cans", "watering can")], 2: [("Garden Rakes", "garden rake")], 3: [("sprinkler", "watering can")], 4: []}
        own.release()
    training = engine.training(dataset)
    for matching, want in (("plain", {3}), ("stemmed", {1, 2, 3}), ("both", {1, 2, 3})):
        parser = CustomEntityParser(UnitConfig("custom_entities", {"matching": matching})).fit(training)
        parser.save(str(tmp_path / matching))
        assert {r["id"] for r in load_unit(spark, str(tmp_path / matching)).parse(texts).collect()} == want
