"""Embedding near-duplicates: int8 tile products with rigorous quantisation bounds, then double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import connected_components, join_unique, materialize, sliced
from parlance.llm.simhash import local_roots

#: Vectors of a strip (a task holds two strips), and of a tile whose products are made at once.
STRIP = 16_384
TILE = 1_024
#: Vectors that strips gather about, at most, whatever the table's size; a pivot's vectors are cut into strips where they are many.
PIVOTS = 1_024
#: Whole numbers up to 2 ** 24 are exact in single precision, so that many products of two codes can be summed there: 127 * 127 * 1024 < 2 ** 24.
EXACT_TERMS = 1_024
#: What rounding in double precision can do to an angle or a bound, with room to spare.
SLACK = 1e-6


Codes = tuple[np.ndarray, np.ndarray, np.ndarray]


def quantise(x: np.ndarray) -> Codes:
    """Int8 codes, scale and error bound of each unit vector: |x - scale * code| <= error, computed, not assumed."""
    scale = np.abs(x).max(1, initial=0) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - scale[:, None] * codes, axis=1)
    return codes, scale, error


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of int8 codes, for any dimension: summed in single precision by at most EXACT_TERMS terms at a time, where
    every partial sum is a whole number that it holds exactly, and beyond that in double precision."""
    part = lambda at: a[:, at : at + EXACT_TERMS].astype(np.float32) @ b[:, at : at + EXACT_TERMS].astype(np.float32).T
    out = part(0)
    for at in range(EXACT_TERMS, a.shape[1], EXACT_TERMS):
        out = out.astype(np.float64) + part(at)
    return out


def upper_bounds(products: np.ndarray, s: np.ndarray, t: np.ndarray, e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """No cosine of two quantised unit vectors is above its entry, but for rounding in double precision. products: of their codes; s and t their scales, e and f their
    errors, all of shapes that fit.

    With x = s q + e and y = t r + f, x.y = s t (q.r) + e.(t r) + (s q).f + e.f. As |x| = |y| = 1, |s q| <= 1 + |e| and |t r| <= 1 + |f|, so all but
    the first term is at most |e| (1 + |f|) + (1 + |e|) |f| + |e| |f| = |e| + |f| + 3 |e| |f|. The first term is exact but for two multiplications.
    """
    return s * t * products + (e + f + 3 * e * f)


def possible(x: Codes, y: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a tile whose upper bound reaches the threshold. One comparison with a bound for each row, by the largest scale and
    error that it meets, leaves few for the bound of the pair itself."""
    (q, s, e), (r, t, f) = x, y
    if not len(q) or not len(r):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    products = code_products(q, r)
    least = (threshold - SLACK - e - f.max() - 3 * e * f.max()) / (s * t.max())
    # rounded down to single precision; below zero the largest scale gives no bound, so every pair goes on
    least = np.where(least > 0, least * (1 - 1e-6) - 1, -np.inf).astype(np.float32)
    i, j = np.nonzero(products >= least[:, None])
    ok = upper_bounds(products[i, j].astype(np.float64), s[i], t[j], e[i], f[j]) >= threshold - SLACK
    return i[ok], j[ok]


def strip_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine of at least threshold between two strips, or within one if y is None (first below second).

    x and y are in double precision and unit length. Tiles whose caps can't come close enough are left out: with
    angle t between tile centres and radii a and b, no pair is closer than t - a - b. Of the others the products of
    int8 codes are made, and pairs whose upper bound reaches the threshold are computed again in double precision.
    """
    limit = np.arccos(threshold) + SLACK
    same = y is None
    y = x if same else y
    qx = quantise(x)
    qy = qx if same else quantise(y)

    def caps(z: np.ndarray) -> list[tuple[int, int, np.ndarray, float]]:
        out = []
        for a in range(0, len(z), TILE):
            part = z[a : a + TILE]
            centre = part.sum(0)
            centre = centre / (np.linalg.norm(centre) or 1)
            out.append((a, a + len(part), centre, float(np.arccos(np.clip((part @ centre).min(), -1, 1)))))
        return out

    for a, b, cx, rx in (tiles_x := caps(x)):
        for c, d, cy, ry in tiles_x if same else caps(y):
            if same and c < a or np.arccos(np.clip(cx @ cy, -1, 1)) - rx - ry > limit:
                continue
            i, j = possible(tuple(z[a:b] for z in qx), tuple(z[c:d] for z in qy), threshold)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 18):
                p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                ok = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
                if ok.any():
                    yield p[ok], q[ok]


def unit(flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The vectors of one size that begin at places of a flat array, scaled to length one."""
    x = flat[at[:, None] + np.arange(size)]
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, unit vectors) of a column of lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, unit(flat, starts[at], int(size))


class Pivots:
    """Unit vectors that others gather about, by dimension; a vector whose dimension has none gets a pivot of its dimension without a place."""

    def __init__(self, vectors: list[list[float]]) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if vectors:
            for size, at, x in by_size(pa.array(vectors, pa.list_(pa.float64()))):
                self.of[size] = (at, x)

    def angles(self, size: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pivots, and the angle of each vector to each of them."""
        if size not in self.of:
            return np.array([-size]), np.zeros((len(x), 1))
        ids, centres = self.of[size]
        return ids, np.arccos(np.clip(x @ centres.T, -1, 1))


def dealt_to_strips(numbered: DataFrame, pivots: Pivots, threshold: float, strip: int) -> tuple[DataFrame, int]:
    """a, b, strip, vertex, copies, x: every vector in each pair of strips (a <= b, one of them its own) in which it can have a link; and the number of pairs.

    Vectors are with their nearest pivot, whose radius is the largest angle among them. One that has a link with a vector about
    another pivot is at most that pivot's radius and the threshold's angle away from it; so only such pivots' strips get a copy, before
    anything is shuffled. Only a count and a radius for each pivot reach the driver.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            pivot, angle = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for size, at, x in by_size(batch.column(0)):
                ids, angles = pivots.angles(size, x)
                best = angles.argmin(1)
                pivot[at], angle[at] = ids[best], angles[np.arange(len(at)), best]
            yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(angle)], ["pivot", "angle"])

    about = numbered.select("x").mapInArrow(nearest, "pivot long, angle double").groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    limit = float(np.arccos(threshold)) + SLACK
    radius, parts, first, total = {}, {}, {}, 0
    for r in sorted(about):
        radius[r["pivot"]], parts[r["pivot"]], first[r["pivot"]] = r["radius"] + limit, -(-r["n"] // strip), total
        total += parts[r["pivot"]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            key = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(7)
            for size, at, x in by_size(batch.column(3)):
                ids, angles = pivots.angles(size, x)
                best = ids[angles.argmin(1)]
                own = np.array([first[p] for p in best.tolist()]) + (key[at] % np.array([parts[p] for p in best.tolist()], np.uint64)).astype(np.int64)
                reach = np.array([radius.get(p, -1.0) for p in ids.tolist()])
                i, j = np.nonzero((angles <= reach[None, :]) | (ids[None, :] == best[:, None]))
                many = np.array([parts.get(p, 0) for p in ids.tolist()])[j]
                other = np.repeat(np.array([first.get(p, 0) for p in ids.tolist()])[j], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                i = np.repeat(i, many)
                for k in range(0, len(i), 4096):
                    rows, to = at[i[k : k + 4096]], other[k : k + 4096]
                    mine = own[i[k : k + 4096]]
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine, to)), pa.array(np.maximum(mine, to)), pa.array(mine), taken.column(0), taken.column(2), taken.column(3)], ["a", "b", "strip", "vertex", "copies", "x"])

    made = numbered.select("vertex", "class_key", "copies", "x").mapInArrow(deal, "a long, b long, strip long, vertex long, copies long, x array<double>")
    return made, total * (total + 1) // 2


def embedding_links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", strip: int = STRIP) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector, links being cosines of at least threshold in double precision.

    Every pair of vectors is covered. Vectors that are equal are one vertex from the start. Vectors are dealt to
    strips by their nearest pivot, and to those pairs of strips alone in which they can have a link (see `dealt_to_strips`); each pair of strips
    is held by one task, with a tile of products. A task gives each vector's number of links there and one edge to the smallest
    member of what it is linked to there, never the pairs. Work grows with the square of the number of distinct vectors,
    less what the bounds on strips and tiles leave out; that is the method's, and the README says so.

    Vectors that are null, empty, zero or hold null or non-finite components, or whose dimension differs from another's, link
    with nothing (there). In a strip, vectors with the same nearest neighbour of a few lie together, so tiles have narrow caps where the data have
    clusters. Null ids give rows but are no component's id; repeated ids count as vectors of their own.
    """
    spark = vectors.sparkSession
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
    bad = F.coalesce(F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("x", lambda c: c != 0), F.lit(True))
    v = v.withColumn("x", F.when(~bad, F.col("x")))
    rows, _ = materialize(v.withColumn("class_key", F.when(F.col("x").isNotNull(), F.xxhash64("x"))), "vectors")
    classes = rows.where("x is not null").groupBy("class_key", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    numbered, _ = materialize(classes.select(F.monotonically_increasing_id().alias("vertex"), "class_key", "least", "copies", "x"), "classes")
    # no more strips than it takes: where vectors lie too far apart for pivots to tell, each goes to every strip
    wanted = min(PIVOTS, max(-(-numbered.count() // strip), spark.sparkContext.defaultParallelism // 2, 1))
    pivots = Pivots([r["x"] for r in numbered.orderBy("class_key", "vertex").select("x").limit(wanted).collect()])
    dealt, pairs = dealt_to_strips(numbered, pivots, threshold, strip)
    dealt = dealt.repartition(max(1, min(pairs, 8 * spark.sparkContext.defaultParallelism)), "a", "b").sortWithinPartitions("a", "b", "strip", "vertex")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grouped() -> Iterator[tuple[tuple[int, int], list[pa.RecordBatch]]]:
            key, held = None, []
            for batch in batches:
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)] if len(a) else [0]
                for s, e in zip(cuts, cuts[1:]):
                    here = (int(a[s]), int(b[s]))
                    if here != key and held:
                        yield key, held
                        held = []
                    key = here
                    held.append(batch.slice(s, e - s))
            if held:
                yield key, held

        for (first, second), parts in grouped():
            table = pa.Table.from_batches(parts)
            strips, vertex, copies = (table[c].to_numpy() for c in ("strip", "vertex", "copies"))
            degree, to = np.zeros(len(vertex), np.int64), np.arange(len(vertex))
            for _, at, x in by_size(table["x"].combine_chunks()):
                one, two = np.flatnonzero(strips[at] == first), np.flatnonzero(strips[at] == second)
                if first != second and not (len(one) and len(two)):
                    continue
                one, two = (o[np.argsort((x[o] @ x[o[:64]].T).argmax(1), kind="stable")] if len(o) else o for o in (one, two))
                root = np.arange(len(at))
                for p, q in strip_links(x[one], None if first == second else x[two], threshold):
                    p, q = one[p], two[q]
                    degree[at] += np.bincount(p, copies[at][q], len(at)).astype(np.int64) + np.bincount(q, copies[at][p], len(at)).astype(np.int64)
                    root = local_roots(len(at), root[p], root[q])[root]
                to[at] = at[root]
            some = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(vertex[some]), pa.array(vertex[to[some]]), pa.array(degree[some])], ["u", "v", "n"])

    found, _ = materialize(dealt.mapInArrow(products, "u long, v long, n long"), "vector-links")
    degrees = found.groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "vertex")
    roots, _ = connected_components(found.select("u", "v"), "vector-components")
    rooted = numbered.join(degrees, "vertex", "left").join(roots.withColumnRenamed("v", "vertex"), "vertex", "left")
    rooted = rooted.select("class_key", "x", "least", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "vertex").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = rooted.join(component, "root").select("class_key", F.col("x").alias("same_x"), (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    own = rows.where("x is not null")
    # two vectors may share a key, so the vectors are compared as well
    good = join_unique(own, judged, "class_key", own.count()).where("x = same_x").select("vec_id", "n_links", "component_id")
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"))


#: All pairs in double precision, and the least id reachable over the links.
ORACLE = """
WITH RECURSIVE vecs AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), good AS (SELECT vec_id, x FROM vecs WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9
), reach(vec_id, root) AS (SELECT vec_id, vec_id FROM vecs UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.vec_id WHERE r.root < l.v
), least AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least
"""
