"""Parsing operators against plain versions and on hard rows."""

import itertools
import logging
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance import logs
from parlance.functions import text
from parlance.operators import classifier, crf, entities, features, ordering, parsers, tagging
from parlance.operators.token_features import FeatureConfig, token_features
from parlance.plans import gen, parser_queries, registry

LONG = "word1 " * 3000 + "End."


def plain_tokens(said):
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W]+|[$%!?&]", said)]


@pytest.mark.parametrize("said", ["", " ", "a", "x" * 500, "a b  c!?", "über-naïve 100% ok_1, ünd", "!!!", LONG, "\n\ttab\u3000wide 🙂 smile"])
def test_tokens_cover_any_length(spark, said):
    got = [(r["value"], r["s"], r["e"]) for r in text.tokens(spark.createDataFrame([(1, said)], "id long, text string"), ["id"]).orderBy("i").collect()]
    assert got == plain_tokens(said)


def test_rows_with_equal_or_null_keys_keep_their_own_tokens(spark):
    """Repeated and null keys, null texts, an empty table, and columns with clashing names."""
    rows = [(1, "ab cd", 9), (1, "ab cd", 9), (None, "x y", 9), (None, "z 5%", 9), (2, None, 9), (3, "", 9)]
    df = spark.createDataFrame(rows, "id long, text string, s long").withColumn("e", F.lit(1)).withColumn("value", F.lit("clash"))
    got = sorted((r["id"] or 0, r["i"], r["value"], r["s"], r["e"]) for r in text.tokens(df, ["id"]).collect())
    assert got == sorted([(1, 0, "ab", 0, 2), (1, 1, "cd", 3, 5)] * 2 + [(0, 0, "x", 0, 1), (0, 1, "y", 2, 3), (0, 0, "z", 0, 1), (0, 1, "5", 2, 3), (0, 2, "%", 3, 4)])
    found = entities.builtin_matches(df, ["id"], ("percentage",)).collect()
    assert [(r["id"], r["s"], r["e"], r["value"]) for r in found] == [(None, 2, 4, "5%")]
    known = spark.createDataFrame([("k", "ab cd", 2, "AB"), ("k", "y", 1, "Y")], "kind string, norm string, n_tokens int, resolved string")
    assert sorted((r["id"] or 0, r["value"]) for r in entities.gazetteer_matches(df, ["id"], known).collect()) == [(0, "y"), (1, "ab cd"), (1, "ab cd")]
    for empty in (text.tokens(df.limit(0), ["id"]), entities.builtin_matches(df.limit(0), ["id"]), entities.gazetteer_matches(df, ["id"], known.limit(0))):
        assert empty.count() == 0


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 200):
        values = list(range(n))
        got = spark.createDataFrame([(values,)], "v array<int>").select(text.running_sums(F.col("v"))).first()[0]
        assert got == [sum(values[:k]) for k in range(n + 1)]


def brute_hits(said, matches, models):
    """Every subset of entities that does not overlap, replaced and compared token by token."""
    out = set()
    for pick in range(1 << len(matches)):
        own = sorted(m for k, m in enumerate(matches) if pick >> k & 1)
        if any(a[1] > b[0] for a, b in zip(own, own[1:])):
            continue
        parts, at = [], 0
        for s, e, kind in own:
            parts += [t[0].lower() for t in plain_tokens(said[at:s])] + [f"%{kind}%"]
            at = e
        parts += [t[0].lower() for t in plain_tokens(said[at:])]
        for intent, wanted in models:
            if parts == wanted:
                out.add((intent, tuple((s, e) for s, e, _ in own)))
    return out


def test_any_subset_of_entities_equals_brute_force(spark):
    rng, words = random.Random(2), "go to red bar now".split()
    models = [(f"i{k}", [rng.choice([*words, "%x%", "%y%"]) for _ in range(rng.randrange(1, 6))]) for k in range(60)]
    models = [m for k, m in enumerate(models) if m[1] not in [o[1] for o in models[:k]]] + [("none", [])]
    texts, rows, want = [], [], set()
    for i in range(150):
        said = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 8)))
        toks, own = plain_tokens(said), set()
        for _ in range(rng.randrange(0, 9) if toks else 0):
            a = rng.randrange(len(toks))
            b = min(len(toks) - 1, a + rng.randrange(2))
            own.add((toks[a][1], toks[b][2], rng.choice("xy")))
        texts.append((i, said))
        rows += [(i, s, e, k, said[s:e]) for s, e, k in own]
        want |= {(i, intent) for intent, _ in brute_hits(said, sorted(own), models)}
    model_rows = spark.createDataFrame([(i, [f"s{k}" for k, p in enumerate(ps) if p[0] == "%"], sum(p[0] == "%" for p in ps), ps, []) for i, ps in models], "intent string, slot_names array<string>, n_slots long, parts array<string>, stops array<string>")
    df, found = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(rows, "id long, s long, e long, kind string, value string")
    hits = parsers.find(df, found, parsers.indexed(model_rows), ["id"]).collect()
    assert {(r["id"], r["intent"]) for r in hits} == want and len(hits) == len(want)
    held = {(i, s, e, k) for i, s, e, k, _ in rows}
    for r in hits:
        assert r["n_slots"] == len(r["found"]) and all((r["id"], x["s"], x["e"], x["kind"]) in held for x in r["found"])
        assert all(a["e"] <= b["s"] for a, b in zip(r["found"], r["found"][1:]))


def test_many_entities_are_no_obstacle(spark):
    """Forty entities, of which a key takes all, one or none."""
    said = " ".join(str(i) for i in range(40))
    rows = [(1, t[1], t[2], "number", t[0]) for t in plain_tokens(said)]
    models = [("all", ["%number%"] * 40), ("last", [str(i) for i in range(39)] + ["%number%"]), ("raw", [str(i) for i in range(40)]), ("not", ["%number%"] * 39)]
    model_rows = spark.createDataFrame([(i, ["s"] * sum("%" in p for p in ps), sum("%" in p for p in ps), ps, []) for i, ps in models], "intent string, slot_names array<string>, n_slots long, parts array<string>, stops array<string>")
    df, found = spark.createDataFrame([(1, said)], "id long, text string"), spark.createDataFrame(rows, "id long, s long, e long, kind string, value string")
    assert {r["intent"]: len(r["found"]) for r in parsers.find(df, found, parsers.indexed(model_rows), ["id"]).collect()} == {"all": 40, "last": 1, "raw": 0}


def test_partial_and_loose_matches(spark):
    known = spark.createDataFrame([("film", "la la land", 3, "La La Land"), ("film", "land", 1, "Land"), ("film", "the big blue sea", 4, "Sea")], "kind string, norm string, n_tokens int, resolved string")
    texts = spark.createDataFrame([(1, "La la land"), (2, "la land"), (3, "big blue sea")], "id long, text string")
    got = {(r["id"], r["resolved"]): r["share"] for r in entities.partial_matches(texts, ["id"], known, 0.5).collect()}
    assert got == {(1, "La La Land"): 1.0, (1, "Land"): 1.0, (2, "La La Land"): pytest.approx(2 / 3), (2, "Land"): 1.0, (3, "Sea"): 0.75}
    loose = entities.with_parts(known, spark.createDataFrame([("film", 0.6)], "kind string, strictness double"))
    assert {(r["norm"], r["resolved"]) for r in loose.collect()} == {("la la land", "La La Land"), ("land", "Land"), ("the big blue sea", "Sea"), ("la la", "La La Land"), ("la land", "La La Land"), ("the big blue", "Sea"), ("big blue sea", "Sea")}
    assert {(r["id"], r["resolved"]) for r in entities.gazetteer_matches(texts, ["id"], loose).collect()} >= {(2, "La La Land"), (3, "Sea")}


def plain_gaps(tokens, entries, strictness, stops=()):
    """All runs of tokens that are a subset of an entry's words in its order, by trying all subsets."""
    out = {}
    for norm, resolved in entries:
        words = norm.split()
        n, runs = len(words), set()
        for size in range(max(1, -int(-strictness * n // 1)), n + 1):
            for chosen in itertools.combinations(words, size):
                runs |= {(i, size) for i in range(len(tokens) - size + 1) if tuple(tokens[i : i + size]) == chosen and (size == n or not set(chosen) <= set(stops))}
        for i, size in runs:
            if not any((j, k) != (i, size) and j <= i and i + size <= j + k for j, k in runs):
                out[i, size] = min(out.get((i, size), (1, "~")), (-size / n, resolved))
    return {(i, size, r, -s) for (i, size), (s, r) in out.items()}


@pytest.mark.parametrize("strictness", [0.3, 0.5, 0.75])
@pytest.mark.parametrize("stops", [(), ("the", "of")])
def test_gapped_matches_equal_all_subsets(spark, strictness, stops):
    rng = random.Random(int(strictness * 100) + len(stops))
    words = "the of red blue sea land old north".split()
    entries = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(25)}
    entries = [(n, n.upper()) for n in sorted(entries)]
    texts = [[rng.choice([*words, "x"]) for _ in range(rng.randrange(0, 11))] for _ in range(40)]
    known = spark.createDataFrame([("k", n, len(n.split()), r) for n, r in entries] + [("strict", "red", 1, "R")], "kind string, norm string, n_tokens int, resolved string")
    strict = spark.createDataFrame([("k", strictness), ("strict", 1.0)], "kind string, strictness double")
    stop_words = spark.createDataFrame([("k", w) for w in stops], "kind string, word string") if stops else None
    frame = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(texts)] + [(99, None)], "id long, text string")
    got = {(r["id"], r["s"], r["value"].lower(), r["resolved"], round(r["share"], 9)) for r in entities.gapped_matches(frame, ["id"], known, strict, stop_words).collect()}
    place = lambda t, i: len(" ".join(t[:i])) + (i > 0)
    assert got == {(k, place(t, i), " ".join(t[i : i + n]), r, round(share, 9)) for k, t in enumerate(texts) for i, n, r, share in plain_gaps(t, entries, strictness, stops)}
    assert entities.filed(known, strict).count() <= sum(len(n.split()) for n, _ in entries)


def test_values_of_many_words_are_found(spark):
    known = entities.gazetteer(spark.createDataFrame([("product", "big red steel bolt with a nut", "B")], "kind string, surface string, resolved string"))
    found = gen.found(spark.createDataFrame([(1, "i need 3 big red steel bolt with a nut from x")], "id long, text string"), known)
    assert ("product", "big red steel bolt with a nut") in {(r["kind"], r["value"]) for r in found.collect()}


@pytest.mark.parametrize(
    ("language", "said", "want"),
    [
        ("en", "call tomorrow at 5 pm", {("date", "tomorrow"), ("time", "5 pm"), ("datetime", "tomorrow at 5 pm")}), ("en", "from 10:30 am on friday", {("time", "10:30 am"), ("date", "friday"), ("datetime", "10:30 am"), ("datetime", "friday")}),
        ("en", "the 5th of march or may 6", {("date", "5th of march"), ("date", "may 6"), ("datetime", "5th of march"), ("datetime", "may 6")}), ("en", "this evening, next week, in june", {("timePeriod", "this evening"), ("datePeriod", "next week"), ("datePeriod", "june")}),
        ("en", "tonight at noon", {("timePeriod", "tonight"), ("time", "noon"), ("datetime", "noon")}), ("de", "nächste Woche am Montag um 8 Uhr", {("datePeriod", "nächste Woche"), ("date", "Montag"), ("time", "8 Uhr"), ("datetime", "Montag um 8 Uhr")}),
        ("fr", "lundi prochain", {("date", "lundi prochain"), ("datetime", "lundi prochain")}), ("es", "el 3 de mayo", {("date", "3 de mayo"), ("datetime", "3 de mayo")}), ("ja", "2031-05-06 17:45", {("date", "2031-05-06"), ("time", "17:45"), ("datetime", "2031-05-06 17:45")}),
    ],
)
def test_dates_and_times(spark, language, said, want):
    df = spark.createDataFrame([(1, said)], "id long, text string")
    got = entities.builtin_matches(df, ["id"], ("date", "time", "datetime", "datePeriod", "timePeriod"), language).collect()
    assert {(r["kind"], r["value"]) for r in got} == want and all(said[r["s"] : r["e"]] == r["value"] for r in got)


def test_units_of_other_languages(spark):
    df = spark.createDataFrame([(1, "3 Stunden bei 20 Grad Celsius"), (2, "2 semaines"), (3, "5 días")], "id long, text string")
    of = lambda lang: {(r["id"], r["kind"], r["value"], r["unit"]) for r in entities.builtin_matches(df, ["id"], ("duration", "temperature"), lang).collect()}
    assert of("de") == {(1, "duration", "3 Stunden", "hour"), (1, "temperature", "20 Grad Celsius", "celsius")}
    assert of("fr") == {(2, "duration", "2 semaines", "week")} and of("es") == {(3, "duration", "5 días", "day")} and of("ja") == set()


def test_batches_of_sequences_are_decoded_as_one_by_one():
    rng = random.Random(3)
    import numpy as np
    import pyarrow as pa

    tags = ["O", "B-a", "I-a"]
    names = [f"f{i}" for i in range(30)]
    tagger = crf.Tagger({n: {t: rng.uniform(-2, 2) for t in tags} for n in names}, {(a, b): rng.uniform(-1, 1) for a in tags for b in tags}, tags)
    sequences = [[[rng.choice([*names, "unknown"]) for _ in range(rng.randrange(0, 5))] for _ in range(rng.randrange(0, 12))] for _ in range(80)]
    sizes = np.array([len(s) for s in sequences])
    counts = np.array([len(f) for s in sequences for f in s])
    flat = pa.array([x for s in sequences for f in s for x in f], pa.string())
    for padded in (1, 50, 100_000):
        got = tagger.tag_many(sizes, counts, flat, padded)
        assert [tags[i] for i in got] == [t for s in sequences for t in tagger.tag(s)]


def test_tag_samples_follow_spans(spark):
    texts = spark.createDataFrame([(1, "go to new york now"), (2, ""), (3, "go")], "id long, text string")
    none = spark.createDataFrame([], "id long, kind string, s long, e long")
    made = token_features(texts, none, features=(FeatureConfig("ngram", {"n": 1}),))
    spans = spark.createDataFrame([(1, "city", 6, 14)], "id long, slot_name string, s long, e long")
    for scheme, want in (("IO", ["I-city"] * 2), ("BIO", ["B-city", "I-city"]), ("BILOU", ["B-city", "L-city"])):
        got = {r["id"]: r["tags"] for r in crf.samples(made, spans, scheme).collect()}
        assert got == {1: ["O", "O", *want, "O"], 2: [], 3: ["O"]}
    with pytest.raises(ValueError):
        crf.samples(made, spans, "other")
    with pytest.raises(ValueError):
        tagging.ends(F.lit("O"), F.lit("O"), "other")


def test_rows_are_numbered_as_by_one_window(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abz") for _ in range(rng.randrange(0, 5))), rng.choice(["p", "q", None])) for _ in range(300)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "w string, g string, k long")
    got = {r["k"]: r["n"] for r in ordering.numbered(df, F.substring("w", 1, 2), ["w", "k"], ["g"]).collect()}
    for g in ("p", "q", None):
        own = sorted((w, k) for k, (w, of) in enumerate(rows) if of == g)
        assert [got[k] for _, k in own] == list(range(len(own)))


def test_frequent_terms_weigh_alike(spark, monkeypatch):
    counts = spark.createDataFrame([(d, t, 1 + (d + t) % 3) for d in range(40) for t in range(30) if t == 0 or (d * t) % 7 < 3], "doc long, term long, tf long").withColumn("term", F.col("term").cast("string"))
    idf = features.document_frequencies(counts, "doc")
    rows = lambda df: sorted((r["doc"], r["term"], round(r["w"], 9)) for r in df.collect())
    every = rows(features.weights(counts, idf.select("term", "idf"), "doc"))
    for share in (1, 2, 1000):
        monkeypatch.setattr(features, "FREQUENT", share)
        assert rows(features.weights(counts, idf, "doc")) == every


def test_vocabulary_keeps_what_tells_classes_apart(spark):
    rows = [(k, t, 1) for k in range(40) for t in (["alpha", "pair:alpha+x"] if k % 2 else ["beta", "pair:beta+x"]) + ["common"]]

    def kept(rows, **how):
        counts = spark.createDataFrame(rows, "id long, term string, tf long")
        stats = features.chi2(counts, counts.select("id", (F.col("id") % 2).cast("string").alias("class")).distinct(), "id")
        return sorted(r["term"] for r in classifier.chosen_terms(stats, 2, classifier.Featurizer(**how)).collect())

    assert kept(rows, added_cooccurrence_feature_ratio=0.5, pvalue_threshold=0.05) == ["alpha", "beta", "pair:alpha+x"]
    assert kept([(k, "common", 1) for k in range(4)], pvalue_threshold=0.0) == ["common"]
    assert features.chi2_critical(spark, 0.05, 1) == pytest.approx(3.841, abs=1e-3) and features.chi2_critical(spark, 0.05, 4) == pytest.approx(9.488, abs=1e-3)


def test_logs_are_made_only_when_written(caplog):
    made = []
    message = logs.Deferred("{}", lambda: made.append(1))
    logging.getLogger("parlance").debug(message)
    assert made == [] and str(message) == "None" and made == [1]

    @logs.timed("adding")
    @logs.result_logged("sum", logging.INFO)
    def add(a, b):
        return a + b

    with caplog.at_level(logging.INFO, "parlance"):
        assert add(1, 2) == 3
    assert "sum: 3" in caplog.text and "adding took" in caplog.text


def test_titles_and_separators(spark):
    df = spark.createDataFrame([("the lord of THE rings, part_2",)], "t string")
    assert df.select(text.title_but(F.col("t"), ["of", "the"])).first()[0] == "the Lord of THE Rings, Part_2"
    assert df.select(text.title_but(F.col("t"), [])).first()[0] == "The Lord Of The Rings, Part_2"
    assert text.separator("ja") == "" and text.separator("en") == " "


def test_both_parsers_read_entities_found_once(spark, monkeypatch):
    import duckdb

    asked, kept, sf = [], gen.kept, "/root/testdata/sf0.001"
    monkeypatch.setattr(gen, "kept", lambda *a: asked.append(1) or kept(*a))
    got = sorted(tuple(r) for r in parser_queries.get_intents_union_max(spark, sf).collect())
    con = duckdb.connect()
    for name in ("orders", "part", "customer"):
        con.sql(f"CREATE VIEW {name} AS FROM '{sf}/{name}.parquet'")
    assert len(asked) == 1 and got == sorted(con.sql(registry.ORACLES["get_intents_union_max"]).fetchall())
