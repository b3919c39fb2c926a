"""The pipeline against a plain version of its stages."""

import random
import re

import pytest

import corpus_pipeline
from parlance.llm import quality_classifier, secrets, shingles, simhash

from .conftest import prose
from .test_group_operators import components, plain_print
from .test_text_operators import check_packing


def jaccard(a, b, n=5):
    a, b = ({tuple(t.split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_dedup_catches_copies_with_some_words_changed(spark):
    """Copies at similarities from 0.8 to 0.95, a crowd of near copies of one text, and texts that only share a part."""
    rng, texts = random.Random(7), {}
    for i in range(80):
        texts[i] = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(900)) for _ in range(300))
    copies = {}
    for i in range(60):
        words, low = texts[i].split(), (0.8, 0.85, 0.9, 0.95)[i % 4]
        while jaccard(" ".join(words), texts[i]) > low:
            last, words = words, list(words)
            words[rng.randrange(300)] = f"new{rng.randrange(10**6)}"
        copies[1000 + i] = " ".join(last)
        assert jaccard(copies[1000 + i], texts[i]) >= 0.8
    crowd = {2000 + i: " ".join([*texts[70].split()[:-1], f"end{i}"]) for i in range(400)}
    half = {3000 + i: " ".join([*texts[i].split()[:150], *texts[i + 5].split()[150:]]) for i in range(60, 65)}
    rows = [(i, t, "en", "s", len(t)) for i, t in (texts | copies | crowd | half).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(texts) | set(half)


def test_near_copies_are_found_by_fingerprints_first(spark, monkeypatch):
    """Pairs within two bits are linked by fingerprints, and only pairs of what these leave apart are made by bands."""
    rng = random.Random(11)
    texts = {i: " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000)) for i in range(12)}
    copies = {100 + i: f"{texts[i]} end" for i in range(12)}
    docs = spark.createDataFrame(list((texts | copies).items()), "doc_id long, text string")
    made, write = {}, shingles.materialize

    def kept(df, name):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(shingles, "materialize", kept)
    prints = {i: shingles.majority(shingles.shingle_set(t.encode())) for i, t in (texts | copies).items()}
    close = [i for i in texts if (prints[i] ^ prints[100 + i]).bit_count() <= 2]
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(texts) and len(close) > 6
    assert made["fingerprint-pairs"][0].count() == len(close) and made["band-pairs"][0].count() == 12 - len(close)


@pytest.mark.parametrize("block", [shingles.BLOCK, 16])
def test_crowds_below_and_above_the_similarity_equal_brute_force(spark, block):
    """Texts edited more or less from texts that are not there themselves, and chains of small edits: the same groups as all pairs give."""
    rng, texts = random.Random(3), []
    for _ in range(3):
        base = [f"w{rng.randrange(10**5)}" for _ in range(120)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        for _ in range(12):
            base = list(base)
            base[rng.randrange(120)] = f"c{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    want = components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r["doc_id"]: r["root"] for r in shingles.classes(docs, 0.8, 5, block).collect()}
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root[i], []).append(i)
    assert len(set(want)) > 20 and [min(groups[root[i]]) for i in range(len(texts))] == want


def test_pipeline(spark, tmp_path):
    clean = {i: prose(i, 60 + i % 90) for i in range(200)}
    copies = {300 + i: clean[i] for i in range(20)}
    junk = {400 + i: " ".join(w.upper() + "!!" for w in prose(800 + i, 80).split()) for i in range(40)}
    secret = {500: prose(600, 80) + " password=abcdef123456 " + prose(601, 40)}
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in (clean | copies | junk | secret).items()] + [(900, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
        kept[name] = docs.collect()
    of = lambda name: {r["doc_id"]: r["text"] for r in kept[name]}
    accepted = of("quality_classifier")
    assert not set(accepted) & (set(junk) | {900}) and len(accepted) >= 218
    ids = sorted(accepted)
    prints = [plain_print(accepted[i]) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert set(of("simhash_near_dedup")) == {i for k, i in enumerate(ids) if components(len(ids), pairs)[k] == k}
    hidden = of("secret_scan")
    assert set(hidden) == set(of("simhash_near_dedup")) and "[SECRET]" in hidden[500] and not re.search("abcdef123456", hidden[500])
    assert all(r["n_chars"] == len(r["text"]) for r in kept["secret_scan"])
    mixed = of("source_mixing")
    assert set(mixed) <= set(hidden) and len(mixed) > 100
    check_packing(kept["best_fit_packing"], mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept["best_fit_packing"])
    assert len({n for n, _ in corpus_pipeline.STAGES}) == 5 and quality_classifier.BITS and secrets.KINDS


def test_stages_on_hard_rows(spark, hard, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and extra columns: no stage fails, none changes the columns, and clean rows stay."""
    hard.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    dedup = corpus_pipeline.near_dedup(spark, docs, "")
    left = [r["doc_id"] for r in dedup.collect()]
    assert dedup.columns == docs.columns and sorted(left, key=repr) == sorted([1, 3, 5, 7, 8, None], key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    assert {r["doc_id"] for r in corpus_pipeline.secret_scan(spark, docs, "").collect()} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
