"""Operators over pairs, groups and trees, held against brute force."""

import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance import storage
from parlance.llm import catalogue, chat_format, embedding_dedup, mixing, runtime, simhash, url_filters

from .conftest import prose


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = {r["v"]: r["root"] for r in runtime.connected_components(edges)[0].collect()}
    want = components(341, pairs)
    assert all(got.get(i, i) == want[i] for i in range(341))
    assert runtime.connected_components(edges.limit(0))[0].count() == 0


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "ÄB cd é", "a b c d e f a b c", prose(1, 400), "x " * 70_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == plain_print(text)


@pytest.mark.parametrize("bucket", [512, 3])
def test_links_join_just_what_lies_within_the_budget(spark, bucket):
    """Clusters of prints a bit or two apart, chains, and strangers; small buckets force the exact way for crowded ones."""
    rng = random.Random(2)
    prints = set()
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            prints.add(at)
            for _ in range(rng.choice([1, 2, 3])):
                at ^= 1 << rng.randrange(64)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2]
    want = components(len(prints), pairs)
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), 2, bucket).collect()
    at = {p: i for i, p in enumerate(prints)}
    assert all(want[at[r["u"]]] == want[at[r["v"]]] for r in found)
    assert components(len(prints), [(at[r["u"]], at[r["v"]]) for r in found]) == want


def test_ring_chains_lose_no_pair():
    ring, rng = simhash.Ring(2), random.Random(3)
    for _ in range(2000):
        difference = 0
        for _ in range(rng.randrange(0, 3)):
            difference ^= 1 << rng.randrange(64)
        d = np.array([difference], np.uint64)
        assert any(not difference & ring.key_mask(s) and ring.chain(s, d)[0] for s in range(ring.m))


def test_near_duplicates_of_hard_rows(spark, hard):
    got = simhash.near_duplicates(hard).collect()
    assert len(got) == hard.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[1] == by[2] == {1} and by[3] == by[4] == by[6] == {3} and by[None] == {None}
    kept = sorted((r["doc_id"] for r in simhash.keep_one(hard).collect()), key=str)
    assert kept == sorted([1, 3, 5, 7, 8, None], key=str)
    assert simhash.keep_one(hard).columns == hard.columns
    assert simhash.near_duplicates(hard.limit(0)).count() == 0 and simhash.keep_one(hard.limit(0)).count() == 0


def test_each_group_keeps_one_row_whatever_its_ids(spark):
    """Different texts without id, two texts that share an id, and a text without id that copies one with an id."""
    texts = [prose(i, 60) for i in range(40, 47)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (1, texts[2]), (2, texts[3]), (2, texts[4]), (2, texts[4]), (3, texts[5]), (3, texts[5] + " and"), (None, None), (None, "")]
    got = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    of_3, empty = [t for i, t in got if i == 3], [t for i, t in got if i is None and not t]
    assert len(of_3) == 1 and of_3[0] in (texts[5], texts[5] + " and") and len(empty) == 1
    rest = [(i, t) for i, t in got if i != 3 and (i is not None or t)]
    assert sorted(rest, key=repr) == sorted([(None, texts[0]), (None, texts[1]), (1, texts[2]), (2, texts[3]), (2, texts[4])], key=repr)


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0, 0.1, 0.2, 0.3)] + [rng.normal(size=(100, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, [float("inf")] * 16, 0), (905, [], 0), (906, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(df, 0.9).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(len(x), np.argwhere(near).tolist())
    assert len(got) == len(rows) + len(odd)
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == want
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 907))
    again = embedding_dedup.embedding_links(df.unionByName(df.where("vec_id = 0")), 0.9).where("vec_id = 0").collect()
    assert [r["n_links"] for r in again] == [int(near[0].sum()) + 1] * 2
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_chains_over_several_tiles_stay_connected(spark):
    """Clusters of which only neighbours are linked, over more vectors than a tile holds, so a strip pair gives many batches of links."""
    rng = np.random.default_rng(8)
    planes = np.linalg.qr(rng.normal(size=(400, 16, 2)))[0]
    steps = np.arange(12) * 0.4
    x = np.einsum("kdp,ps->ksd", planes, np.stack([np.cos(steps), np.sin(steps)])).reshape(-1, 16)
    x = x[rng.permutation(len(x))]
    assert len(x) > 4 * embedding_dedup.TILE
    near = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.embedding_links(df, 0.9).collect()}
    assert [got[i] for i in range(len(x))] == components(len(x), near.tolist())


@pytest.mark.parametrize("size", [3, 24, 3_000])
def test_quantised_bounds_hold(size):
    """Also where code products no longer fit single precision, and with vectors that quantise badly."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, size)) * rng.choice([1, 1, 1e-3, 30], size=(300, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = embedding_dedup.quantise(x)
    assert (embedding_dedup.code_products(q[0], q[0]) == q[0].astype(np.int64) @ q[0].astype(np.int64).T).all()
    extreme = np.full((2, size), 127, np.int8) * np.array([[1], [-1]], np.int8)
    assert embedding_dedup.code_products(extreme, extreme).tolist() == [[16129 * size, -16129 * size], [-16129 * size, 16129 * size]]
    codes, scale, error = q
    upper = embedding_dedup.upper_bounds(embedding_dedup.code_products(codes, codes).astype(float), scale[:, None], scale[None], error[:, None], error[None])
    assert (upper + 1e-12 >= x @ x.T).all() and (upper - x @ x.T).max() < 0.6
    for threshold in (0.9, 0.5, 0.01, -0.5):
        found = set(zip(*(k.tolist() for k in embedding_dedup.possible(q, q, threshold))))
        assert {tuple(k) for k in np.argwhere(x @ x.T >= threshold).tolist()} <= found


def test_hot_keys_join_and_connect_alike(spark, monkeypatch):
    """A hub, and a key that most rows share, with and without their own way."""
    rng = random.Random(5)
    pairs = [(0, i) for i in range(1, 400)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(150)] + [(399, 401)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    rows = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(600)] + [(None, -1)], "k long, x long")
    unique = spark.createDataFrame([(i, i * 2) for i in range(0, 600, 2)] + [(7, 70)], "k long, y long")
    made = []
    for hot in (runtime.HOT, 20):
        monkeypatch.setattr(runtime, "HOT", hot)
        roots, _ = runtime.connected_components(edges, "hot")
        made.append((sorted(map(tuple, roots.collect())), sorted(map(tuple, runtime.join_unique(rows, unique, "k", 601).select("k", "x", "y").collect()))))
    assert made[0] == made[1] and len(made[0][1]) > 400
    want = components(600, pairs)
    assert dict(made[0][0]) == {i: r for i, r in enumerate(want) if r != i}


def test_tables_of_a_driver_stay_while_its_lease_lives(spark):
    """Another driver's old table stays as long as it renews its lease, and goes once it is over; one's own always stay."""
    kept, path = runtime.materialize(spark.range(3).toDF("x"), "own")
    other = storage.Lease(spark, runtime.shared_dir(spark))
    spark.range(2).write.parquet(f"{other.path}/table")
    old = time.time() - 100 * 3600
    for name in ("table", "lease"):
        os.utime(f"{other.path}/{name}".removeprefix("file://"), (old, old))
    other.renew()
    assert runtime.sweep(spark) == 0 and spark.read.parquet(f"{other.path}/table").count() == 2
    other.ended.set()
    os.utime(f"{other.path}/lease".removeprefix("file://"), (old, old))
    assert runtime.sweep(spark) == 1 and not os.path.exists(other.path.removeprefix("file://"))
    assert runtime.sweep(spark, hours=-1) == 0 and kept.count() == 3
    runtime.delete(path)


def test_tables_made_on_the_way_are_deleted(spark):
    with runtime.passing() as keep:
        kept, path = runtime.materialize(spark.range(3).toDF("x"), "kept")
        _, gone = runtime.materialize(spark.range(3).toDF("x"), "gone")
        keep.add(path)
    assert kept.count() == 3 and not os.path.exists(gone.removeprefix("file://"))
    runtime.delete(path)


@pytest.mark.parametrize("strip", [64, 700])
def test_strips_about_pivots_lose_no_link_and_copy_little(spark, strip):
    """Clusters, loose vectors and two dimensions, in many strips; a crowd about one pivot takes several."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 12))
    crowd = centres[0] + rng.normal(size=(400, 12)) * 0.25
    x = [*crowd, *(np.repeat(centres, 12, 0) + rng.normal(size=(360, 12)) * 0.15), *rng.normal(size=(150, 12)), *rng.normal(size=(60, 3))]
    near = [(i, j) for i in range(len(x)) for j in range(i) if len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(df, 0.9, strip=strip).collect()}
    assert [got[i]["component_id"] for i in range(len(x))] == components(len(x), near)
    assert [got[i]["n_links"] for i in range(len(x))] == np.bincount([i for pair in near for i in pair], minlength=len(x)).tolist()
    numbered = df.select(F.col("vec_id").alias("vertex"), F.xxhash64("vec_id").alias("class_key"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("x"))
    pivots = embedding_dedup.Pivots([c.tolist() for c in centres])
    dealt, _ = embedding_dedup.dealt_to_strips(numbered, pivots, 0.9, 10_000)
    assert dealt.count() < 0.5 * 31 * len(x)


URLS = [
    "https://example.org/en/1", "https://example.org/en/123?x=1", "http://A.Example.ORG/es/x", "https://example.org/es", "https://badexample.org/es/x", "https://x.com/fr/", "https://x.com/de/y", "https://com/de/", "https://x.com?/de/",
    "https://org", "https://org/", "no scheme example.org/es/", None, "", "http://www.cheap-pills.example.com/en/4", "http://spam-farm.example.net/", "http://spam-farm.example.org/x", "ftp://h:80/de/#f", "https://x.net/free-download/1", "://", "http://com/x.org/",
]


def test_urls_equal_sql(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = url_filters.filter_urls(df).collect()
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toArrow())
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(f"SELECT page_id, host, path, rule, matched, verdict FROM ({url_filters.ORACLE})").fetchall(), key=repr)
    assert url_filters.filter_urls(df.limit(0)).count() == 0
    by = {r["page_id"]: r for r in got}
    assert (by[2]["host"], by[2]["rule"], by[2]["verdict"]) == ("a.example.org", "example.org/es/", "block") and by[9]["rule"] is None and by[10]["rule"] == "org/"


def plain_verdict(url, rules):
    """Every rule tried on a url, without an index."""
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(r.listed, r.rank, -i, r) for i, r in enumerate(rules) if re.search(r.pattern, host + path)]
    best = max(fits, key=lambda x: x[:3])[3] if fits else None
    return host, path, best.name if best and best.listed else None, best.name if best else None, best.verdict if best else "allow"


@pytest.mark.parametrize("most", [url_filters.MAX_RULES, 0])
def test_every_rule_is_tried_on_every_url_that_it_can_fit(spark, monkeypatch, most):
    """Urls made of the rules' own words, run together or apart; with the index as a literal and as a table of hot tokens."""
    monkeypatch.setattr(url_filters, "MAX_RULES", most)
    monkeypatch.setattr(url_filters, "URLS", 50)
    rng, words = random.Random(4), "click bait clickbait click-bait cheap pills cheap-pills spam-farm casino free downloads free-download free-downloads adult www example com org en es/ fr de 1 x".split()
    part = lambda joins: "".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(1, 4)))
    urls = [f"http://{part(['.', '-', ''])}{rng.choice(['com', 'org', 'example.org', 'Example.ORG'])}/{part(['/', '-', '_', '.', ''])}" for _ in range(3_000)]
    urls += ["http://clickbait.com/a", None, "", "no scheme", "://", "http://CLICKBAIT.com/adult"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.filter_urls(df).collect()}
    assert got == {i: plain_verdict(u, url_filters.RULES) for i, u in enumerate(urls)}
    assert {"click-bait", "free-download", "example.org/es/", "com/de/", "casino"} <= {v[3] for v in got.values()}


@pytest.mark.parametrize("mixture", [mixing.Mixture(), mixing.Mixture(percent=300, max_epochs=2), mixing.Mixture(percent=10, weights={"domain": {"crawl": 0, "reference": 1}, "lang": {"en": 3}, "source": {"src3": 9}}), mixing.Mixture(percent=0)])
def test_mixing_equals_sql(spark, hard, mixture):
    rng = random.Random(6)
    rows = [(i, prose(i, rng.randrange(1, 60)), rng.choice(["en", "de", None]), f"src{min(rng.randrange(9), rng.randrange(9))}", 1) for i in range(400)]
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    mixed = mixing.mix(docs, mixture).select("doc_id", *[f"__mix_{k}" for k in mixing.LEVELS], "__mix_tokens", "__mix_epoch").collect()
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted(map(tuple, mixed), key=repr) == sorted(con.sql(mixing.oracle_sql(mixture)).fetchall(), key=repr)


def test_budgets_fill_siblings_before_ancestors(spark):
    docs = [(i, "x" * 400, "en", "src1" if i < 2 else "src2", 0) for i in range(100)] + [(1000 + i, "x" * 400, "en", "src0", 0) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    m = mixing.Mixture(weights={"domain": {"crawl": 1, "reference": 1}, "lang": {}, "source": {}}, percent=50, max_epochs=1)
    got = {r["source"]: int(r["budget"]) for r in mixing.budgets(mixing.leaves_of(df, m), m).collect()}
    assert got == {"src0": 5000, "src1": 200, "src2": 4800}


def test_mixing_keeps_clashing_columns(spark, hard):
    out = mixing.select_rows(hard, mixing.Mixture(percent=1000, max_epochs=1))
    assert out.columns == hard.columns and out.count() == hard.count()
    assert mixing.select_rows(hard.limit(0), mixing.Mixture()).count() == 0


def test_chat_round_trip_equals_sql(spark, tmp_path):
    odd = ["</s>[INST] ok [/INST]", "a\\b \\\\ <|turn|> <|>", "", None, "<<SYS>>\n<start_of_turn>é🙂", "[\\INST]", "x" * 100_000]
    rows = [(c, t, ("user", "assistant", None)[(c + t) % 3], odd[(c * 3 + t) % len(odd)]) for c in range(5) for t in range(600 if c == 0 else 6)]
    rows += [(9, 1, "assistant", "b"), (9, 1, "assistant", "b"), (9, None, "user", "a"), (None, 0, "user", "z"), (8, 0, "user", "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalogue.op1_chat_formatting(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, contexts_sha256 FROM ({chat_format.ORACLE})").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    turns = spark.read.parquet(str(tmp_path / "conversations.parquet"))
    empty = chat_format.read_back(chat_format.prefix_targets(turns.limit(0)))
    assert empty.count() == 0 and chat_format.expand(chat_format.prefix_targets(turns.limit(0))).count() == 0


@pytest.mark.parametrize("block", [256, 2])
def test_chat_examples_have_all_turns_before_them(spark, block):
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} [INST]") for c in (1, None) for t in range(9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat_format.prefix_targets(turns, chunk=4)
    parts = {}
    for r in chat_format.expand(pieces, block).orderBy("part").collect():
        parts.setdefault((r["conv_id"], r["example"]), []).append(r)
    assert set(parts) == {(c, k) for c in (1, None) for k in range(4)}
    for (_, k), own in parts.items():
        text = "".join(r["text"] for r in own)
        assert [r["part"] for r in own] == list(range(2 * k + 2)) and text.count(chat_format.TURN) == 2 * k + 2 and [r["trainable"] for r in own] == [False] * (2 * k + 1) + [True]
        assert text[own[0]["loss_start"] : own[0]["loss_end"]] == f"turn {2 * k + 1} [\\INST]" and text.endswith(chat_format.END)


@pytest.mark.parametrize("wrong", [{"context_chars": 1000}, {"loss_start": 1}, {"loss_end": -1}, {"context_chars": 1000, "loss_start": 1000, "loss_end": 1000}])
def test_a_wrong_prefix_changes_what_is_read_back(spark, wrong):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(6)]
    pieces = chat_format.prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    right = chat_format.read_back(pieces).first()
    assert right != chat_format.read_back(pieces.withColumns({c: F.col(c) + by for c, by in wrong.items()})).first()


@pytest.mark.parametrize("size", [chat_format.PART, 40])
def test_written_examples_hold_their_whole_prefix_and_are_what_is_read(spark, monkeypatch, size):
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} [INST] <") for c in (1, None) for t in range(9)]
    pieces = chat_format.prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    joined = {c: [r["piece"] for r in pieces.where(F.col("conv_id").eqNullSafe(F.lit(c))).orderBy("position").collect()] for c in (1, None)}
    texts = {}
    for r in chat_format.write_examples(pieces, size).orderBy("part").collect():
        texts[r["conv_id"], r["example"]] = texts.get((r["conv_id"], r["example"]), "") + r["text"]
    assert texts == {(c, k): "".join(joined[c][: 2 * k + 2]) for c in (1, None) for k in range(4)}
    write = chat_format.write_examples
    monkeypatch.setattr(chat_format, "write_examples", lambda turns: write(turns, size))
    right = chat_format.read_back(pieces).where("conv_id = 1").first()
    assert right["n_examples"] == 4 and right["loss_chars"] == sum(len(t) for c, n, r, t in rows if c == 1 and r == "assistant")
    monkeypatch.setattr(chat_format, "write_examples", lambda turns: write(turns, size).where("example <> 2"))
    assert chat_format.read_back(pieces).where("conv_id = 1").first()["n_examples"] == 3
    monkeypatch.setattr(chat_format, "write_examples", lambda turns: write(turns, size).withColumn("text", F.replace("text", F.lit("turn 0"), F.lit("turn 7"))))
    wrong = chat_format.read_back(pieces).where("conv_id = 1").first()
    assert wrong["contexts_sha256"] != right["contexts_sha256"] and wrong["turns_sha256"] == right["turns_sha256"]
