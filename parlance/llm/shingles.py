"""Near-duplicate texts by Jaccard similarity of their word shingles: fingerprints find the near pairs and MinHash bands the others, the sets themselves decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import connected_components, join_unique, materialize, sliced

SEED = 42
#: Bands of rows of MinHash values. A pair at Jaccard 0.8 shares no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6, at 0.9 4e-13.
BANDS, ROWS = 32, 5
_mix = np.random.default_rng(SEED)
XOR, TIMES = (_mix.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32) for _ in range(2))
TIMES |= np.uint32(1)


def shingle_set(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's n-word shingles: A-Z lowered, words between ASCII blanks; fewer words: all of them; none: empty."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashing = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) > n else [b" ".join(words)]
    return np.unique(np.array([hashing(s, SEED) for s in shingles], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashes (little-endian uint64): a bit is set if over half of them have it."""
    set_in = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):  # a very long text in slices
        set_in += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(hashes), bitorder="little").tobytes(), "little")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; sets of equal minima in a band share its key. None for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for a in range(0, len(folded), 256):  # pieces that stay in the processor's cache
        np.minimum(low, ((folded[a : a + 256, None] ^ XOR) * TIMES).min(0), out=low)
    return np.array([xxhash.xxh64_intdigest(low[b * ROWS : b * ROWS + ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes that tell rows with different doc_id or text apart; nulls count as values."""
    own = [docs["doc_id"].isNull(), docs["doc_id"], docs["text"].isNull(), docs["text"]]
    return [F.xxhash64(F.lit(k), *own).alias(f"__row{k}") for k in (0, 1)]


#: Pairs of one text that one task decides, and members of a bucket that one task holds for one half of its pairs.
PAIRS, BLOCK = 1_024, 1 << 16
#: Bins that a set's shared shingles are counted in.
BINS = 256


def bin_counts(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles.view(np.uint64) >> np.uint64(5)).astype(np.int64) % BINS, minlength=BINS).astype(np.uint16 if len(shingles) < 1 << 16 else np.uint32)


def reachable(held: np.ndarray, one: np.ndarray, size_held: np.ndarray, size_one: int, similarity: float) -> np.ndarray:
    """Whether sets can have the similarity with one set, by the bin counts of their shingles that occur in any other set at all: two sets' common shingles are
    among those, and in each bin there are at most as many as the lesser count."""
    common = np.minimum(held, one[None, :]).sum(1, dtype=np.int64)
    return common >= similarity * (size_held + size_one - common) - 1e-9


def links(vertices: DataFrame, docs: DataFrame, similarity: float, n: int, near: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct shingle sets of at least that similarity which connect all such pairs that share a band, and those that `near` gives.

    vertices: vertex, n_shingles, fingerprint, bands, __row0, __row1 (a row of docs that has the set). near gives pairs (u, v) of vertices by their fingerprints (vertex,
    fingerprint); they are decided first. A band's bucket makes pairs only where that leaves it in several components, and only of members of different ones: these meet its smallest one, its largest
    one and its hub (whose buckets hold most members: the text that a crowd was copied from, if it is there) first. Only where that leaves a bucket
    in several components, its members of different ones meet pair by pair, and of these pairs only those are made whose counts of
    shared shingles allow the similarity (see `reachable`): texts edited each in its own way lack each its own of the shingles that they were copied
    with, which shows in the counts, so a crowd of them makes few pairs but those that are near. No bucket is capped, one of more than `block` members is
    dealt to several tasks by pairs of parts, and every pair made is decided by the sets.
    """
    keyed = vertices.select("vertex", "n_shingles", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("vertex").alias("lo"), F.max("vertex").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    members, _ = materialize(keyed.join(shared, "key"), "band-members")
    close, _ = materialize(near(vertices.select("vertex", "fingerprint")), "fingerprint-pairs")
    asked = members.select("vertex").unionByName(close.select(F.explode(F.array("u", "v")).alias("vertex"))).distinct()
    met = asked.join(vertices.select("vertex", "__row0", "__row1"), "vertex")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t or b"", n).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["vertex", "shingles"])

    texts = docs.select(docs["text"].cast("string").cast("binary").alias("text"), *row_keys(docs)).join(met, ["__row0", "__row1"]).select("vertex", "text")
    sets, _ = materialize(texts.mapInArrow(sets_of, "vertex long, shingles array<long>").dropDuplicates(["vertex"]), "shingle-sets")

    def decided(pairs: DataFrame) -> DataFrame:
        """Pairs of at least the similarity. Texts in more than PAIRS pairs and more than a ten-thousandth of all, so at most 10,000 of them, are listed in a broadcast
        table; their sets are copied and their pairs spread over the copies, and no shuffle is by such a text alone."""
        limit = max(PAIRS, pairs.count() // 10_000)
        hot = pairs.groupBy("v").agg(F.ceil(F.count("*") / limit).cast("int").alias("copies")).where("copies > 1")
        copies = F.coalesce("copies", F.lit(1))
        of_v = sets.select(F.col("vertex").alias("v"), F.col("shingles").alias("of_v")).join(F.broadcast(hot), "v", "left").select("v", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "of_v")
        dealt = pairs.join(F.broadcast(hot), "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), copies).cast("int").alias("copy"))
        both = dealt.join(sets.select(F.col("vertex").alias("u"), F.col("shingles").alias("of_u")), "u").join(of_v, ["v", "copy"])
        common = F.size(F.array_intersect("of_u", "of_v"))
        near = common >= similarity * (F.size("of_u") + F.size("of_v") - common) - 1e-9
        return materialize(both.where(near).select("u", "v"), "shingle-links")[0]

    def apart(members: DataFrame, edges: DataFrame, name: str, least: int) -> DataFrame:
        """Members, and their roots, of the buckets that the edges leave in several components and that have so many members at least."""
        roots, _ = connected_components(edges, "shingle-components")
        rooted = members.select("key", "n", "vertex", "n_shingles").join(roots.withColumnRenamed("v", "vertex"), "vertex", "left").select("key", "n", "vertex", "n_shingles", F.coalesce("root", "vertex").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("many")).where((F.col("a") != F.col("b")) & (F.col("many") >= least))
        return materialize(rooted.join(mixed.select("key"), "key"), name)[0]

    closest = decided(close)
    members = apart(members, closest, "open-members", 2)
    degree = members.groupBy("vertex").agg(F.sum("n").alias("degree"))
    own = F.struct("vertex", "root")
    ends = members.join(degree, "vertex").groupBy("key").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.max(F.struct("degree", "vertex", "root")).alias("x"))
    ends = ends.select("key", F.array("lo", "hi", F.struct("x.vertex", "x.root")).alias("ends"))
    star = members.join(ends, "key").select(F.col("vertex").alias("u"), "root", F.explode("ends").alias("v")).where("root <> v.root").select("u", F.col("v.vertex").alias("v"))
    star, _ = materialize(star.groupBy(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).agg(F.min(F.struct("u", "v")).alias("x")).select("x.*"), "band-pairs")
    first = closest.unionByName(decided(star))
    left = apart(members, first, "mixed-members", 3)

    crowd = left.select("vertex").distinct().join(sets, "vertex").select("vertex", F.explode("shingles").alias("shingle"))
    common = crowd.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [np.array(s, np.int64) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array([bin_counts(s).astype("<u4").tobytes() for s in own], pa.binary())], ["vertex", "shared", "bins"])

    held = crowd.join(common, "shingle").groupBy("vertex").agg(F.collect_list("shingle").alias("shingles")).mapInArrow(counted, "vertex long, shared long, bins binary")
    held, _ = materialize(held, "shared-counts")
    able = left.join(held, "vertex").where(F.col("shared") >= similarity * F.col("n_shingles") - 1e-9)
    parts = able.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vertex"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, "part").alias("a"), F.greatest(o, "part").alias("b")))
    dealt = able.join(parts, "key").withColumn("part", part).select("key", F.explode(others).alias("p"), "part", "vertex", "n_shingles", "shared", "root", "bins")
    dealt = dealt.select("key", F.col("p.a").cast("long").alias("a"), F.col("p.b").cast("long").alias("b"), F.col("part").cast("long").alias("part"), "vertex", "n_shingles", "shared", "root", "bins")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(us: list, vs: list) -> pa.RecordBatch:
            u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        group, size, held, bins, us, vs, made = None, 0, np.zeros((5, 64), np.int64), np.zeros((64, BINS), np.uint32), [], [], 0
        for batch in batches:  # sorted by key, parts, then size
            counts = batch.column(8).to_pylist()
            for (key, a, b, *row), own in zip(np.stack([c.to_numpy() for c in batch.columns[:8]], 1), counts):
                if (key, a, b) != group:
                    group, size = (key, a, b), 0
                part, vertex, many, shared, root = row
                own, now = np.frombuffer(own, "<u4"), held[:, :size]
                least = np.minimum(now[3], shared)
                near = (now[4] != root) & (least >= similarity * (now[2] + many - least) - 1e-9)
                if a != b:
                    near &= now[0] != part
                at = np.flatnonzero(near)
                if len(at):
                    at = at[reachable(bins[at], own, now[2][at], many, similarity)]
                if len(at):
                    us.append(now[1][at]), vs.append(np.full(len(at), vertex)), (made := made + len(at))
                if size == held.shape[1]:
                    held, bins = np.concatenate([held, np.zeros_like(held)], 1), np.concatenate([bins, np.zeros_like(bins)])
                held[:, size], bins[size] = row, own
                size += 1
                if made > 100_000:
                    yield out(us, vs)
                    us, vs, made = [], [], 0
        yield out(us, vs)

    dealt = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "n_shingles", "vertex")
    asked = star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rest, _ = materialize(dealt.mapInArrow(across, "u long, v long").distinct().join(asked, ["u", "v"], "left_anti"), "crowd-pairs")
    return first.unionByName(decided(rest))


def same_print(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of each vertex with the smallest one of its fingerprint."""
    least = prints.groupBy("fingerprint").agg(F.min("vertex").alias("v"), F.count("*").alias("n")).where("n > 1").select("fingerprint", "v")
    return join_unique(prints, least, "fingerprint", prints.count()).where("vertex <> v").select(F.col("vertex").alias("u"), "v")


def classes(docs: DataFrame, similarity: float = 0.8, n: int = 5, block: int = BLOCK, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, __row0, __row1 (see `row_keys`) and root of every row: one root for all rows that are connected by texts whose
    sets of n-word shingles have at least that Jaccard similarity. Texts without words are one class. near: see `links`; without it equal fingerprints are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t or b"", n) for t in batch.column(3).to_pylist()]
            vertex = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(vertex), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), keys], ["doc_id", "__row0", "__row1", "vertex", "n_shingles", "fingerprint", "bands"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *row_keys(docs), docs["text"].cast("string").cast("binary").alias("text"))
    sketched, _ = materialize(rows.mapInArrow(run, "doc_id long, __row0 long, __row1 long, vertex long, n_shingles long, fingerprint long, bands array<long>"), "shingle-sketches")
    one = sketched.groupBy("vertex").agg(F.min(F.struct("__row0", "__row1", "n_shingles", "fingerprint", "bands")).alias("x")).select("vertex", "x.*")
    vertices, _ = materialize(one, "shingle-vertices")
    roots, _ = connected_components(links(vertices, docs, similarity, n, near or same_print, block), "near-texts")
    joined = sketched.select("doc_id", "__row0", "__row1", "vertex").join(roots.withColumnRenamed("v", "vertex"), "vertex", "left")
    return joined.select("doc_id", "__row0", "__row1", F.coalesce("root", "vertex").alias("root"))
