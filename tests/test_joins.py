"""What is exploded or grouped is never broadcast: Spark takes it for as small as the table that it comes from."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import entities, features, joins, parsers, tagging


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def made(spark):
    texts = spark.range(50).select("id", F.concat(F.lit("get "), F.col("id").cast("string"), F.lit(" red apples")).alias("text"))
    known = spark.range(200).where("id = 0").selectExpr("'fruit' AS kind", "concat('red apples', if(id = 0, '', cast(id AS string))) AS norm", "2 AS n_tokens", "'APPLE' AS resolved")
    return texts, known


def test_ngrams_of_texts_are_not_broadcast(made):
    texts, known = made
    found = entities.gazetteer_matches(texts, ["id"], known)
    assert "BuildRight" in plan(found) and "BuildLeft" not in plan(found)
    assert sorted((r["id"], r["s"], r["value"]) for r in found.collect()) == [(i, 5 + len(str(i)), "red apples") for i in range(50)]


def test_a_large_dictionary_is_shuffled(made, monkeypatch):
    texts, known = made
    few = {tuple(r) for r in entities.gazetteer_matches(texts, ["id"], known).collect()}
    monkeypatch.setattr(joins, "FEW", 0)
    found = entities.gazetteer_matches(texts, ["id"], known)
    assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
    assert {tuple(r) for r in found.collect()} == few


def test_matches_meet_their_texts_without_a_broadcast(made):
    texts, known = made
    found = entities.gazetteer_matches(texts, ["id"], known, [2])
    rewritten, ranges = entities.replace_with_placeholders(texts, found, ["id"])
    assert plan(rewritten).count("SortMergeJoin") == 1 and "BuildLeft" not in plan(rewritten)
    assert sorted(r["rewritten"] for r in rewritten.collect()) == sorted(f"get {i} %FRUIT%" for i in range(50)) and ranges.count() == 50
    models = spark_models(texts)
    hits = parsers.find(texts, found, models, ["id"])
    assert "SortMergeJoin" in plan(hits) and "BuildLeft" not in plan(hits) and hits.count() == 0


def spark_models(texts):
    rows = [("buy", ["x"], ["get", "%FRUIT%"], ["get", "%fruit%"])]
    spark = texts.sparkSession
    return parsers.indexed(spark.createDataFrame([(r[0], r[1], r[3], []) for r in rows], "intent string, slot_names array<string>, parts array<string>, stops array<string>"))


@pytest.mark.parametrize("scheme", ["IO", "BIO", "BILOU"])
def test_tags_within_the_row_are_those_of_rows(spark, scheme):
    """Spans of one and of more tokens, side by side and at both ends, a text without spans, a null one and one without tokens."""
    texts = spark.createDataFrame([(1, "a bb ccc d e"), (2, "no slots"), (3, None), (4, ""), (5, "x y")], "id long, text string")
    spans = spark.createDataFrame([(1, "p", 0, 1), (1, "q", 2, 8), (1, "q", 9, 12), (5, "p", 0, 3)], "id long, slot_name string, s long, e long")
    made = tagging.encoded(texts, spans, ["id"], scheme)
    assert "Window" not in plan(made)
    by_row = tagging.encode(text.tokens(texts, ["id"]), spans, ["id"], scheme)
    assert sorted(map(tuple, text.each(made, ["id"], F.col("tags"), "t").select("id", "t.*").collect())) == sorted(map(tuple, by_row.collect()))
    slots = text.each(made, ["id"], tagging.decoded(F.col("tags"), scheme), "x").select("id", "x.*")
    assert sorted(map(tuple, slots.collect())) == sorted(map(tuple, tagging.decode(by_row, ["id"], scheme).collect()))


def test_word_pairs_of_a_text_are_made_within_its_row(spark):
    texts = spark.createDataFrame([(1, "A b a c"), (1, "a B"), (2, None), (3, "one"), (None, "a b")], "id long, text string")
    made = features.text_pairs(texts, ["id"], 2)
    assert "Window" not in plan(made)
    assert sorted((r["id"] or 0, r["w1"], r["w2"]) for r in made.collect()) == [(0, "a", "b"), (1, "a", "a"), (1, "a", "b"), (1, "a", "c"), (1, "b", "a"), (1, "b", "c")]
    assert sorted((r["w1"], r["w2"]) for r in features.text_pairs(texts.where("id = 1"), ["id"], 2, False).collect()) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "c")]


def test_frequent_words_fetch_no_entries_and_texts_of_the_same_words_are_tried_once(spark):
    """Of 300 entries that share two words, a text that has these apart and two of one entry side by side fetches that one alone."""
    known = spark.range(300).selectExpr("'item' AS kind", "concat('old red w', id, ' x', id) AS norm", "4 AS n_tokens", "concat('W', id) AS resolved")
    strict = spark.createDataFrame([("item", 0.5)], "kind string, strictness double")
    texts = spark.range(40).select("id", F.concat(F.lit("red or old"), F.when(F.col("id") % 2 == 0, " W7, x7").otherwise(" w7 x7")).alias("text"))
    said = entities.with_norms(texts, ["id"]).select("id", "__norms").where("id < 2")
    assert sorted((r["id"], r["norm"]) for r in entities.fetched(said, ["id"], known, strict).collect()) == [(0, "old red w7 x7"), (1, "old red w7 x7")]
    found = entities.gapped_matches(texts, ["id"], known, strict)
    assert sorted((r["id"], r["s"], r["value"], r["resolved"], r["share"]) for r in found.collect()) == [(i, 7, "old W7, x7" if i % 2 == 0 else "old w7 x7", "W7", 0.75) for i in range(40)]


def test_words_are_tokens_without_their_places(spark):
    from parlance.plans import feature_queries, lexicon_queries

    texts = spark.createDataFrame([(1, "Ça va, $5 a_b!\n\u2003x"), (1, "A a"), (2, None), (3, " -- "), (None, "z")], "id long, text string")
    assert sorted(map(str, text.words(texts, ["id"]).collect())) == sorted(map(str, text.tokens(texts, ["id"]).select("id", "i", "value").collect()))
    sf = "/root/testdata/sf0.001"
    made = [lexicon_queries.word_cluster(spark, sf), lexicon_queries.stem_text(spark, sf), lexicon_queries.rare_word_gate(spark, sf), feature_queries.tfidf_transform(spark, sf), feature_queries.vocab_restrict(spark, sf), feature_queries.chi2_scores(spark, sf)]
    for df in made:  # offsets are running sums, which append to an array
        assert "array_append" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_only_what_may_match_is_exploded(made, monkeypatch):
    """Rows that go into the joins with the dictionary and the models: one for a text here, not one for each of its tokens, and the same is found either way."""
    texts, known = made
    rows, few = [], joins.with_few
    monkeypatch.setattr(joins, "with_few", lambda left, *a, **k: (rows.append(left.count()), few(left, *a, **k))[1])
    models = parsers.indexed(texts.limit(1).selectExpr("'i' AS intent", "1L AS n_slots", "array('s') AS slot_names", "array('get', '%number%', '%fruit%') AS parts", "cast(array() AS array<string>) AS stops"))

    def found():
        spans = entities.gazetteer_matches(texts, ["id"], known).drop("resolved")
        numbers = entities.builtin_matches(texts, ["id"], ("number",)).select(*spans.columns)
        hits = parsers.find(texts, numbers.unionByName(spans), models, ["id"])
        return {(r["id"], tuple((x["kind"], x["s"], x["e"]) for x in r["found"])) for r in hits.collect()}

    cut = found()
    assert len(cut) == 50 and rows == [50, 50]
    monkeypatch.setattr(joins, "LITERALS", 0)
    assert found() == cut and min(rows[2:]) > 50


def test_a_bound_value_is_not_taken_from_an_array(made):
    """An element taken from an array has the type of all that makes it worked out for each row."""
    bound = made[0].select(text.bind(F.col("id") + 1, lambda x: x * x).alias("x"))
    assert "transform(" not in plan(bound) and [r["x"] for r in bound.orderBy("x").limit(3).collect()] == [1, 4, 9]


def test_the_tables_of_a_parse_are_not_broadcast(made):
    from parlance.plans.units import Prepared

    texts, ids = made[0], made[0].sparkSession.range(50)
    only = Prepared(texts, texts.selectExpr("id", "'k' AS kind")).only(ids)
    assert "Broadcast" not in plan(only.texts) + plan(only.matches) and only.texts.count() == 50
