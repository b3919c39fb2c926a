"""Hard-negative mining: each anchor's whole list of integer scores is sorted, and negatives are read off below each positive's limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.runtime import materialize

#: Rows whose scores are sorted at a time, and anchors that are scored against them at a time.
CHUNK_BITS = 14
CHUNK = 1 << CHUNK_BITS
ROWS = 64
#: Vector components of the anchors that one task holds, and rows that one task reads past them at most.
HELD = 1 << 22
STRIP = 1 << 20
#: Integer vectors whose squared length reaches this take no part: percentages of their scores may not fit a long.
TOO_LONG = float(1 << 56)
LOW, NO_ID = -(1 << 60), np.iinfo(np.int64).max


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of rows of a with rows of b. Every partial sum is at most the product of the largest lengths; where
    this is below 2 ** 53, doubles hold it exactly in whatever order they are summed."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.sqrt((x * x).sum(1).max() * (y * y).sum(1).max()) < 2**52:
        return (x @ y.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def ranked(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of s sorted by score, highest first, equal ones by column: the negated scores in this order, and their columns. At most CHUNK columns.

    Where a score and a column fit one word, words are sorted; else the scores are, by a stable sort.
    """
    if np.abs(s[s != LOW], dtype=np.int64).max(initial=0) < 1 << (61 - CHUNK_BITS):
        words = np.where(s == LOW, 1 << (61 - CHUNK_BITS), -s) << CHUNK_BITS | np.arange(s.shape[1])
        words.sort(axis=1)
        negated = words >> CHUNK_BITS
        negated[negated == 1 << (61 - CHUNK_BITS)] = -LOW
        return negated, words & (CHUNK - 1)
    order = np.argsort(-s, axis=1, kind="stable")
    return np.take_along_axis(-s, order, 1), order


def merged(s: np.ndarray, ids: np.ndarray, more_s: np.ndarray, more_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of two lists of each anchor along the last axis, as many as the first has: by score, then id."""
    k = s.shape[-1]
    s, ids = np.concatenate([s, more_s], -1), np.concatenate([ids, more_ids], -1)
    order = np.lexsort((ids, -s), axis=-1)[..., :k]
    return np.take_along_axis(s, order, -1), np.take_along_axis(ids, order, -1)


def first_of(negated: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the first k entries of each ranked row, padded with LOW."""
    s, out = np.full((len(negated), k), LOW), np.full((len(negated), k), NO_ID)
    n = min(k, negated.shape[1])
    s[:, :n], out[:, :n] = -negated[:, :n], ids[columns[:, :n]]
    return s, np.where(s == LOW, NO_ID, out)


def below_limits(negated: np.ndarray, columns: np.ndarray, ids: np.ndarray, upper: np.ndarray, lower: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each ranked row and each of its limits, scores and ids of the first k entries of at most the upper limit that reach the lower one, padded
    with LOW. The upper limit is found by binary search."""
    shape = (*upper.shape, k)
    s, out = np.full(shape, LOW), np.full(shape, NO_ID)
    if negated.shape[1]:
        start = np.stack([np.searchsorted(row, -limit) for row, limit in zip(negated, upper)])
        at = start[:, :, None] + np.arange(k)
        there = at < negated.shape[1]
        at = np.minimum(at, negated.shape[1] - 1).reshape(len(negated), -1)
        found = -np.take_along_axis(negated, at, 1).reshape(shape)
        ok = there & (found != LOW) & (found >= lower[:, :, None])
        s[ok], out[ok] = found[ok], ids[np.take_along_axis(columns, at, 1)].reshape(shape)[ok]
    return s, out


class Held:
    """The anchors of a task, with their best entries so far: `positives` of each, or `negatives` of each of its positives."""

    def __init__(self, parts: list[pa.RecordBatch], positives: int, negatives: int, limits: tuple[int, int]) -> None:
        table = pa.Table.from_batches(parts)
        self.table, self.limits, self.negatives = table, limits, negatives
        self.uid, self.label = (table[c].to_numpy() for c in ("uid", "label"))
        self.groups = dict(by_size(table["x"].combine_chunks()))
        self.mining = table["found"].null_count == 0
        shape = (len(self.uid), positives, negatives) if self.mining else (len(self.uid), positives)
        self.s, self.ids = np.full(shape, LOW), np.full(shape, NO_ID)
        self.known = np.full((len(self.uid), positives), LOW)
        if self.mining:
            for i, found in enumerate(table["found"].to_pylist()):
                self.known[i, : len(found)] = [f["score"] for f in found]

    def meet(self, batch: pa.RecordBatch) -> None:
        """Score the rows of a batch against the anchors and keep the best."""
        uid, label = (batch.column(i).to_numpy() for i in (2, 4))
        ids = batch.column(3).fill_null(NO_ID).to_numpy()
        for size, (at, x) in by_size(batch.column(5)):
            if size in self.groups:
                by_id = np.argsort(ids[at], kind="stable")
                at, x = at[by_id], x[by_id]
                mine, y = self.groups[size]
                (self._mine if self.mining else self._match)(mine, y, x, uid[at], ids[at], label[at])

    def _match(self, mine: np.ndarray, y: np.ndarray, x: np.ndarray, uid: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        labels, k = self.label[mine], self.s.shape[1]
        for here in np.intersect1d(labels, label):
            rows, anchors = np.flatnonzero(label == here), np.flatnonzero(labels == here)
            for a in range(0, len(anchors), ROWS):
                part = anchors[a : a + ROWS]
                s = scores(y[part], x[rows])
                s[self.uid[mine[part]][:, None] == uid[rows][None, :]] = LOW
                self._keep(mine[part], *first_of(*ranked(s), ids[rows], k))

    def _mine(self, mine: np.ndarray, y: np.ndarray, x: np.ndarray, uid: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        low, high = self.limits
        for a in range(0, len(mine), ROWS):
            part = mine[a : a + ROWS]
            s = scores(y[a : a + ROWS], x)
            s[self.label[part][:, None] == label[None, :]] = LOW
            known = self.known[part]
            none = known == LOW
            safe = np.where(none, 0, known)
            upper, lower = np.where(none, LOW + 1, safe * high // 100), np.where(none, LOW + 2, -(-safe * low // 100))
            self._keep(part, *below_limits(*ranked(s), ids, upper, lower, self.negatives))

    def _keep(self, at: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        self.s[at], self.ids[at] = merged(self.s[at], self.ids[at], s, ids)

    def result(self) -> pa.RecordBatch:
        where = np.nonzero(self.s != LOW)
        s, ids, which = self.s[where], self.ids[where], where[1] if self.mining else np.zeros(len(where[0]), np.int64)
        columns = [pa.array(self.uid[where[0]]), pa.array(which), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(s)]
        return pa.RecordBatch.from_arrays(columns, ["uid", "which", "id", "score"])


def by_size(column: pa.Array) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(dimension, (places, matrix)) of a column of lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), (at, flat[starts[at][:, None] + np.arange(size)])


def mine(vectors: DataFrame, anchor: Column, label: Column | str = "label", scale: float = 256, positives: int = 5, negatives: int = 3, limits: tuple[int, int] = (50, 95), id_col: str = "vec_id", vector_col: str = "embedding", held: int = HELD) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score: for each row of which `anchor` holds and each of its
    positives, the first `negatives` rows of another label whose score is at least limits[0] and at most limits[1] per cent of the positive's.

    A component x counts as floor(scale * x); a score is the exact integer inner product with the anchor. Higher scores come first, equal ones by id, null
    ids last (the largest long counts as null). An anchor's positives are its first `positives` other rows of the same label. Rows with a null label or a vector that is null or holds null or
    non-finite components take no part; nor do those whose rounded vector's squared length is 2 ** 56 or more. Rows that share an id are
    rows of their own, as anchors too; equal rows are each other's positives. Only vectors of one dimension meet; an anchor without positives, or a positive without such
    negatives, gives no row. An empty table gives none. Further columns are not read.

    Each task holds a block of anchors (of at most `held` components, whatever the table's size) and reads a strip of all rows past them, CHUNK at a time: all scores of an anchor in a
    chunk are sorted, the positive's upper limit is found in them by binary search, and the next entries are read while they
    reach the lower limit. The best of the chunks are merged in the task, and those of an anchor's strips by a window over a few entries from each. So
    every anchor meets every row, as is asked for, but no pair leaves a task; rows are copied once a block of anchors, anchors once a strip. Labels and hot vectors play no
    part in how rows are dealt.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    scaled = F.transform(vectors[vector_col].cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c).cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("x"), F.transform(vectors[vector_col].cast("array<double>"), lambda c: F.isnan(c) | (F.abs(c) == float("inf"))).alias("odd"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    size = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    good = F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("odd", lambda o: o.isNull() | o) & (size < TOO_LONG)
    rows, _ = materialize(rows.where(good).select(F.monotonically_increasing_id().alias("uid"), "id", "label", F.col("x").cast("array<int>").alias("x"), "anchor"), "mining-rows")
    total, n_anchors, dimension = rows.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.when(F.col("anchor"), F.size("x"))), F.lit(1))).first()
    blocks = max(1, -(-n_anchors * max(dimension, 1) // held))
    tasks = 2 * spark.sparkContext.defaultParallelism
    strips = max(-(-total // STRIP), min(-(-total // (CHUNK // 4)), -(-tasks // blocks)), 1)
    block, strip = F.pmod(F.xxhash64("uid"), F.lit(blocks)), F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(strips))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    tile = (F.col("block") * strips + F.col("strip")).alias("tile")
    found_type = "array<struct<id:bigint,score:bigint>>"
    passed = rows.select(number(blocks).alias("block"), strip.alias("strip"), "uid", "id", "label", "x").select(tile, F.lit(1).alias("side"), "uid", "id", "label", "x", F.lit(None).cast(found_type).alias("found"))

    def best(anchors: DataFrame) -> DataFrame:
        """uid, which, id, score: the best entries of the anchors in each strip."""
        dealt = anchors.select(block.alias("block"), number(strips).alias("strip"), "uid", "id", "label", "x", "found").select(tile, F.lit(0).alias("side"), "uid", "id", "label", "x", "found")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, parts, state, gathered, n = None, [], None, [], 0

            def flush() -> None:
                nonlocal gathered, n
                if gathered and state is not None:
                    state.meet(pa.Table.from_batches(gathered).combine_chunks().to_batches()[0])
                gathered, n = [], 0

            for batch in batches:
                tiles, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero((tiles[1:] != tiles[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(tiles)] if len(tiles) else [0]
                for a, b in zip(cuts, cuts[1:]):
                    if tiles[a] != key:
                        flush()
                        if state is not None:
                            yield state.result()
                        key, parts, state = tiles[a], [], None
                    part = batch.slice(a, b - a)
                    if side[a] == 0:
                        parts.append(part)
                        continue
                    if state is None and parts:
                        state, parts = Held(parts, positives, negatives, limits), []
                    for c in range(0, part.num_rows, CHUNK):
                        piece = part.slice(c, CHUNK)
                        if n + piece.num_rows > CHUNK:
                            flush()
                        gathered.append(piece)
                        n += piece.num_rows
            flush()
            if state is not None:
                yield state.result()

        tiles = dealt.unionByName(passed).repartition(max(1, min(blocks * strips, 8 * tasks)), "tile").sortWithinPartitions("tile", "side")
        return tiles.mapInArrow(run, "uid long, which long, id long, score long")

    def first(entries: DataFrame, n: int) -> DataFrame:
        place = F.row_number().over(W.partitionBy("uid", "which").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
        return entries.withColumn("rank", place).where(F.col("rank") <= n)

    anchors = rows.where("anchor").select("uid", "id", "label", "x")
    matched = first(best(anchors.withColumn("found", F.lit(None).cast(found_type))), positives)
    matched = matched.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    matched = matched.select("uid", F.transform("found", lambda f: F.struct(f["id"].alias("id"), f["score"].alias("score"))).alias("found"))
    known, _ = materialize(anchors.join(matched, "uid"), "mining-anchors")
    mined = first(best(known), negatives).select("uid", "which", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = F.col("found")[F.col("which").cast("int")]
    return mined.join(known.select("uid", F.col("id").alias("anchor_id"), "found"), "uid").select("anchor_id", positive["id"].alias("positive_id"), "rank", "negative_id", positive["score"].alias("positive_score"), "negative_score")


ORACLE = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
), positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
