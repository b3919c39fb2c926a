"""SimHash near-duplicates: a pigeonring filter over ring segments before the full Hamming check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import shingles
from parlance.llm.runtime import connected_components, join_unique, key_runs, materialize, sliced
from parlance.llm.shingles import majority

BITS = 64
SEED = 42
#: Distinct fingerprints of one bucket that are compared pair by pair; larger buckets take the exact way of `flips`.
BUCKET = 512


def fingerprint(text: bytes, n: int = 3) -> int:
    """SimHash of a text in UTF-8: A-Z lowered, words between ASCII blanks, n-word shingles with repeats (fewer words:
    all of them; none: zero), XXH64 with seed 42; a bit is set if over half of the hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    hashing = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) > n else [b" ".join(words)]
    hashes = np.array([hashing(s, SEED) for s in shingles], "<u8")
    return majority(hashes)


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every whole text. A map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = np.array([fingerprint(t or b"", n) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fingerprint"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


class Ring:
    """Segments of a fingerprint on a ring, and the pigeonring condition for a Hamming budget.

    With budget t and m segments, two fingerprints within t have some segment from which on every chain of
    1..m consecutive segments differs in at most t/m bits for each of its segments (rounded down to whole bits).
    """

    def __init__(self, budget: int, segments: int | None = None) -> None:
        self.budget, self.m = budget, segments or 2 * budget + 1
        edges = [round(i * BITS / self.m) for i in range(self.m + 1)]
        self.masks = np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])], np.uint64)
        self.allowed = [budget * length // self.m for length in range(1, self.m + 1)]
        self.exact = sum(a == 0 for a in self.allowed)  # leading segments that must agree: the index key

    def key_mask(self, start: int) -> int:
        return int(np.bitwise_or.reduce([self.masks[(start + i) % self.m] for i in range(self.exact)]))

    def chain(self, start: int, difference: np.ndarray) -> np.ndarray:
        """Which differences satisfy the chain from `start`; those whose leading segments agree are given."""
        ok, total = np.ones(len(difference), bool), np.zeros(len(difference), np.int64)
        for length in range(self.exact, self.m):
            total += np.bitwise_count(difference & self.masks[(start + length) % self.m])
            ok &= total <= self.allowed[length]
        return ok


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n vertices over the links a-b, within one task."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def flips(f: np.ndarray, budget: int) -> np.ndarray:
    """Each fingerprint with all sets of up to budget/2 bits flipped, as rows; two fingerprints within an even budget share one,
    and fingerprints that share one are within the budget."""
    ones = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    masks = [np.uint64(0)]
    layer = [(np.uint64(0), -1)]
    for _ in range(budget // 2):
        layer = [(mask | ones[i], i) for mask, last in layer for i in range(last + 1, BITS)]
        masks += [mask for mask, _ in layer]
    return f[:, None] ^ np.array(masks, np.uint64)[None, :]


def links(distinct: DataFrame, budget: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect just those within `budget` bits, directly or over others.

    Each fingerprint is filed under every start of the ring by the segments that must agree there. A
    bucket's pairs go through the chains of cumulative differences, then the full Hamming check, and leave as
    edges to the smallest linked member, at most one a member. A bucket over `bucket` members is read in pieces
    and not paired: its members take the exact way instead, in which fingerprints meet at every common
    neighbour within half the budget and link to the smallest one there. So no bucket is ever held whole, none
    is capped, and no step makes pairs in the square of a bucket's size. budget must be even for that way.
    """
    if budget % 2:
        raise ValueError("the budget must be even")
    ring = Ring(budget)
    keyed = distinct.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(_signed(ring.key_mask(i))) for i in range(ring.m)])).alias("start", "key"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, large = [], [], []

        def out() -> pa.RecordBatch:
            columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs, large)]
            made = pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(bool))], ["u", "v", "large"])
            us.clear(), vs.clear(), large.clear()
            return made

        for (start, _), (f,), whole in key_runs(batches, 2, bucket):
            n = len(f)
            if not whole:
                us.append(f), vs.append(f), large.append(np.ones(n, np.int64))
            elif n > 1:
                values = f.view(np.uint64)
                a, b = np.triu_indices(n, 1)
                difference = values[a] ^ values[b]
                near = ring.chain(int(start), difference)
                a, b, difference = a[near], b[near], difference[near]
                near = np.bitwise_count(difference) <= budget
                root = local_roots(n, a[near], b[near])
                linked = np.flatnonzero(root != np.arange(n))
                us.append(f[linked]), vs.append(f[root[linked]]), large.append(np.zeros(len(linked), np.int64))
            if len(us) > 5000:
                yield out()
        yield out()

    dealt = keyed.select(F.col("start").cast("long").alias("start"), "key", "fingerprint").repartition("start", "key").sortWithinPartitions("start", "key", "fingerprint")
    found, _ = materialize(dealt.mapInArrow(pairs, "u long, v long, large boolean").distinct(), "links")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy()
            for a in range(0, len(f), 4096):
                near = flips(f[a : a + 4096].view(np.uint64), budget)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(f[a : a + 4096], near.shape[1])), pa.array(near.ravel().view(np.int64))], ["fingerprint", "meet"])

    crowd = found.where("large").select(F.col("u").alias("fingerprint")).distinct().mapInArrow(spread, "fingerprint long, meet long")
    least = crowd.groupBy("meet").agg(F.min("fingerprint").alias("v"), F.max("fingerprint").alias("most")).where("v <> most").select("meet", "v")
    met = crowd.join(least, "meet").select(F.col("fingerprint").alias("u"), "v").where("u <> v").distinct()
    return found.where("not large").select("u", "v").unionByName(met)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near_duplicates(docs: DataFrame, budget: int = 2, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (a long) and component_id of every row: the smallest doc_id reachable over links between
    fingerprints that differ in at most `budget` bits.

    Rows with equal fingerprints are one vertex from the start, so a group of copies, however large, costs one
    fingerprint. Null and empty texts have fingerprint zero and link like any other. Null ids are left out when the
    smallest id is taken (null if a component has no other); repeated rows each give a row. An empty table
    gives an empty result. Other columns are not read.
    """
    prints, _ = materialize(fingerprints(docs, n, id_col, text_col), "prints")
    groups = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots, _ = connected_components(links(groups.select("fingerprint"), budget), "fingerprint-links")
    rooted = groups.join(roots, groups["fingerprint"] == roots["v"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fingerprint", "root").join(component, "root").select("fingerprint", "component_id")
    return join_unique(prints, classes, "fingerprint", prints.count()).select("doc_id", "fingerprint", "component_id")


def near_vertices(prints: DataFrame, budget: int = 2) -> DataFrame:
    """Pairs (u, v) of vertices that connect those whose fingerprints differ in at most `budget` bits. prints: vertex, fingerprint."""
    least, _ = materialize(prints.groupBy("fingerprint").agg(F.min("vertex").alias("least")), "least-vertices")
    of = lambda c: least.select(F.col("fingerprint").alias(c), F.col("least").alias(f"of_{c}"))
    edges, _ = materialize(links(least.select("fingerprint"), budget), "near-prints")
    near = join_unique(edges.join(of("u"), "u"), of("v"), "v", edges.count()).select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
    return near.unionByName(shingles.same_print(prints)).distinct()


def keep_one(docs: DataFrame, similarity: float = 0.8, n: int = 5, budget: int = 2) -> DataFrame:
    """The rows, with all their columns, of one document of each group of near-duplicates: the one with the smallest
    doc_id (null last), of several texts with that id the one with the smallest hash. Of equal rows, by id and text, one stays.
    So each group keeps one row, whether its ids are null, shared with other groups or neither.

    Near-duplicates are texts whose sets of n-word shingles have at least that Jaccard similarity, directly or over others. Fingerprints of the sets find the near ones
    (`links`, at most `budget` bits apart), and the sets decide each pair. Texts at 0.8 differ in about ten of 64 bits, and an index for so many has no bits left that must agree:
    what fingerprints leave apart is looked for by MinHash bands too (`shingles.links`).

    Rows are dealt once, by two hashes of id and text, for the join and for the equal rows.
    """
    keys = ["__row0", "__row1"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)).alias("x")
    kept, _ = materialize(shingles.classes(docs, similarity, n, near=lambda prints: near_vertices(prints, budget)).groupBy("root").agg(first).select(*[f"x.{k}" for k in keys]), "kept")
    return docs.select("*", *shingles.row_keys(docs)).join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
