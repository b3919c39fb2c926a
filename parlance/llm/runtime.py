"""What the operators of this subpackage share: Arrow helpers, joins with hot keys, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.storage import delete, fresh_path, materialize, passing, shared_dir, sweep

__all__ = ["delete", "fresh_path", "materialize", "passing", "shared_dir", "sweep"]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, and of fewer where rows of the batch have a mean of more than size / rows bytes, so
    that what a task makes of them at a time stays small. An empty batch gives none."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


#: Rows of one key from which on a join deals them to many tasks.
HOT = 100_000


def join_unique(rows: DataFrame, unique: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined by a key with a table that has each key once; total: the number of rows.

    Keys that more than HOT rows and more than a ten-thousandth of all rows share, of which there are at most 10,000 whatever the data, are
    broadcast, so their rows stay where they are; the others are shuffled. Null keys join with nothing.
    """
    if total <= HOT:
        return rows.join(unique, key)
    hot = F.broadcast(rows.groupBy(key).count().where(F.col("count") > max(HOT, total // 10_000)).select(key))
    often = rows.join(F.broadcast(unique.join(hot, key, "left_semi")), key)
    return often.unionByName(rows.join(hot, key, "left_anti").join(unique, key))


def connected_components(edges: DataFrame, name: str = "cc") -> tuple[DataFrame, str | None]:
    """Smallest reachable vertex of every vertex of an undirected graph.

    edges has long columns `u` and `v`; the result has `v` and `root` for each vertex that is not
    the smallest of its component (isolated and smallest vertices are their own root). Alternates the
    large-star and small-star steps of Kiveris et al. (2014) until the edges stay the same. Every step is
    a minimum per vertex (combined before the shuffle) and a join with it, in which the edges of a hub stay
    spread (see `join_unique`). Edges between rounds are tables in the shared folder.
    Empty edges give an empty result; self loops and repeated edges are ignored.
    """
    tidy = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, path = materialize(tidy, name)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root")), path
        before, total = tuple(state), 2 * state[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_unique(both, low, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_unique(large, least, "u", total)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        following, at = materialize(small.where("u <> v").distinct(), name)
        delete(path)
        now, path = following, at


def key_runs(batches: Iterator[pa.RecordBatch], n_keys: int, limit: int) -> Iterator[tuple[tuple, list[np.ndarray], bool]]:
    """Runs of equal keys in batches sorted by their first n_keys integer columns.

    Yields (key, the other columns as arrays, whole). A run of more than `limit` rows comes in pieces
    of at most that many rows, all but its last marked as not whole, as are all that follow the first,
    so memory stays bounded whatever the size of a group.
    """
    held: list[np.ndarray] | None = None
    key: tuple | None = None
    cut = False
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        n = len(columns[0])
        if not n:
            continue
        change = np.zeros(n, bool)
        for c in columns[:n_keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change), [n]])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            here = tuple(c[a] for c in columns[:n_keys])
            part = [c[a:b] for c in columns[n_keys:]]
            if held is not None and here == key:
                part = [np.concatenate(x) for x in zip(held, part)]
            else:
                if held is not None:
                    yield key, held, not cut
                cut = False
            key = here
            while len(part[0]) > limit:
                yield key, [c[:limit] for c in part], False
                part, cut = [c[limit:] for c in part], True
            held = part
    if held is not None:
        yield key, held, not cut
