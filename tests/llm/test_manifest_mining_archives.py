"""Merkle manifest, hard-negative mining and WARC archives against plain versions, on rows that are hard to get right."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import hard_negatives, merkle, runtime, warc


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(rows):
    """rows of doc_id, source, lang, n_chars, text."""
    by = {}
    for row in rows:
        text = row[4]
        if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), plain_leaf((*row[:4], text)), row[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort()
        trees.append(plain_tree([x[2] for x in by[s]]))
    top, out = plain_tree([t[-1][0] for t in trees]), []
    for k, s in enumerate(sources):
        for i, x in enumerate(by[s]):
            folded, proof = x[3], ""
            for levels, at in ((trees[k], i), (top, k)):
                for hashes in levels[:-1]:
                    run, slot = hashes[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    folded = digest("".join(run[:slot] + [folded] + run[slot + 1 :]))
                    at //= 16
            out.append((x[4], x[2], trees[k][-1][0], top[-1][0], digest(proof), folded, folded == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("seed", [1, 2])
def test_manifest_equals_a_plain_one(spark, seed):
    """Sources of 1, 2, 16, 17, 256, 257 and 4,400 documents, a null and an empty one, repeated ids and rows, nulls everywhere, odd texts."""
    rng, rows = random.Random(seed), []
    sizes = {None: 5, "": 3, "one": 1, "two": 2, "s16": 16, "s17": 17, "s256": 256, "s257": 257, "Ä": 40, "big": 4_400 if seed == 1 else 600}
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "plain", "Mixed CASE", "Ünïcode 🙂 A", "x" * 9_000 + "Q"])
            rows.append((rng.choice([None, rng.randrange(10**6), rng.randrange(10**6), rng.randrange(50)]), source, rng.choice(["en", None]), rng.choice([None, 7]), text))
    rows += rows[:20] + [(8, "many", "en", 1, "SAME")] * 700
    docs = spark.createDataFrame([r + (1, "x") for r in rows], SCHEMA + ", tree int, pos string").repartition(5)
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    one = [(3, None, None, None, None)]
    assert [tuple(r) for r in merkle.manifest(spark.createDataFrame(one, SCHEMA)).collect()] == plain_manifest(one)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_mining(rows, k=3, positives=5, limits=(50, 95)):
    """rows of vec_id, label, vector, is_anchor."""
    good = [(i, label, [int(np.floor(256 * x)) for x in v], a, n) for n, (i, label, v, a) in enumerate(rows) if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good = [g for g in good if sum(x * x for x in g[2]) < 1 << 56]
    out = []
    for i, label, v, anchor, n in good:
        if not anchor:
            continue
        scored = [(-sum(map(int.__mul__, v, w)), j is None, j or 0, lab, j) for j, lab, w, _, m in good if m != n and len(w) == len(v)]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[3] == label][:positives]:
            fits = [s for s in scored if s[3] != label and limits[0] * -p[0] <= 100 * -s[0] <= limits[1] * -p[0]][:k]
            out += [(i, p[4], r, s[4], -p[0], -s[0]) for r, s in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize(("held", "size"), [(hard_negatives.HELD, 8), (40, 8), (hard_negatives.HELD, 2)])
def test_mining_equals_brute_force(spark, held, size):
    """Coarse vectors for many ties; nulls, NaN, infinities, other dimensions, repeated ids, long vectors; blocks of few anchors too."""
    rng, rows = random.Random(size), []
    for i in range(400):
        v = [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(size)]
        v = rng.choice([v] * 12 + [None, [*v[1:], None], [*v[1:], float("nan")], [*v[1:], float("inf")], v[1:], [x * 1e6 for x in v], [x * 1e9 for x in v], [-abs(x) for x in v]])
        rows.append((rng.choice([i] * 9 + [None, i // 2]), rng.choice([None, 0, 0, 0, 1, 2, 3, -4]), v, i % 9 == 0))
    rows += [(900, 1, [0.5] * size, True)] * 3
    data = spark.createDataFrame([r + ("x", 0) for r in rows], "vec_id long, label int, embedding array<double>, is_anchor boolean, uid string, which int").repartition(3)
    got = sorted((tuple(r) for r in hard_negatives.mine(data, F.col("is_anchor"), held=held).collect()), key=key)
    assert got == sorted(plain_mining(rows), key=key) and got


def test_mining_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, 1, []), (1, 1, []), (2, 3, [])], schema), F.col("vec_id") % 50 == 0).collect() == [(0, 1, 1, 2, 0, 0)]


def test_sorted_scores_are_exact():
    """Scores that fit a word with their column, and scores that do not, are ordered alike."""
    rng = np.random.default_rng(1)
    for top in (50, 1 << 55):
        s = rng.integers(-top, top, (5, 300)) // 7 * 7
        s[:, ::11] = hard_negatives.LOW
        negated, columns = hard_negatives.ranked(s)
        want = np.argsort(-s, axis=1, kind="stable")
        assert (columns == want).all() and (negated == np.take_along_axis(-s, want, 1)).all()
    a = rng.integers(-(1 << 27), 1 << 27, (3, 4))
    assert hard_negatives.scores(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, q)) for q in a] for r in a]


def plain_pages(rows, min_bytes=0):
    """rows of page_id, url, html: for each payload, how many responses and revisits by page."""
    by, out = {}, []
    for page, _, html in rows:
        by.setdefault((html or "").encode(), []).append(page)
    for payload, pages in by.items():
        told = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        pages.sort(key=lambda p: (p is not None, p or 0), reverse=True)
        for i, page in enumerate(pages):
            again = i > 0 and len(payload) >= min_bytes
            out.append((page, len(payload), told, "revisit" if again else "response", pages[0] if again else None))
    return out


INSIDE = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: 666\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"


@pytest.mark.parametrize(("min_bytes", "block"), [(0, "128m"), (0, "700"), (100, "3000")])
def test_archives_round_trip(spark, min_bytes, block):
    """Payloads that hold the magic, whole records, and headers whose successors lie far off; equal payloads, ids and rows; nulls; splits smaller than records."""
    rng, rows = random.Random(4), []
    for i in range(150):
        html = rng.choice([None, "", "short", f"<p>{i}</p>" * rng.randrange(1, 300), INSIDE * 3, f"{i}WARC/1.0\r\n", "WARC/1.0\r\n" * rng.randrange(1, 40), INSIDE.replace("40", "5000"), "WWARC/1.0\r", "\r\n\r\n" * 5, "ünï🙂" * 50, f"HTTP/1.1 x\r\n\r\n{i}"])
        rows.append((rng.choice([i, i, i, None, i // 3, -i]), rng.choice([None, f"http://x.org/{i}", "bad\r\nWARC/1.0\r\n\nurl"]), html))
    rows += rows[:10] + [(7, "http://same.org", "same")] * 30
    pages = spark.createDataFrame([r + ("x", 1) for r in rows], "page_id long, url string, html string, key string, size int").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = runtime.fresh_path(spark, "archives")
    warc.write_archives(pages, path, min_bytes)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = warc.read_archives(spark, path).collect()
        if block == "700":
            assert warc.scan(spark, path).select("file", "split").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(plain_pages(rows, min_bytes), key=key)
    assert all(r["intact"] for r in got if r["record_type"] == "response")


def test_archives_of_no_pages_and_damaged_ones(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0
    path = runtime.fresh_path(spark, "archives")
    spark.createDataFrame([(warc.MAGIC + "Content-Length: 3\r\n\r\nabc",), (warc.MAGIC + "Content-Length: 5\r\n\r\nabc",)], "value string").coalesce(1).write.option("lineSep", warc.GAP).text(path)
    with pytest.raises(ValueError, match="1 archives"):
        warc.read_archives(spark, path)
