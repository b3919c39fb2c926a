"""Best-fit packing of token sequences after Martello-Toth dominance reduction."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.runtime import materialize, sliced
from parlance.llm.token_counts import byte_alphabet

#: Pieces of equal length that one task ranks together, on average.
GROUP_ROWS = 1000

Pattern = tuple[int, tuple[int, ...]]  # so many sequences, each holding these lengths


def _smallest(counts: np.ndarray, n: int) -> list[int]:
    """The n smallest items, with repetition."""
    out: list[int] = []
    for size in np.flatnonzero(counts)[:n].tolist():
        out += [size] * min(int(counts[size]), n)
    return out[:n]


def _best_pair(counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two items with the largest sum that is at most room, the larger first."""
    sizes = np.flatnonzero(counts).tolist()
    best, low, high = None, 0, len(sizes) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or (low == high and counts[sizes[low]] < 2):
            high -= 1
            continue
        if best is None or total > sum(best):
            best = (sizes[high], sizes[low])
        low += 1
    return best


def _dominating(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside an item of size j (already taken out of counts) so that the set dominates every
    feasible set with j; None if that can't be shown.

    A set dominates another if the other's items can be put, in groups, inside its own items one for one.
    """
    room = capacity - j
    small = _smallest(counts, 3)
    fit = sum(np.cumsum(small) <= room)
    if not fit:
        return ()
    largest = int(np.flatnonzero(counts[: room + 1])[-1])
    if fit == 1 or largest == room:
        return (largest,)
    if fit > 2:
        return None
    a, b = _best_pair(counts, room)  # two smallest fit, so there is one
    if largest >= a + b:
        return (largest,)
    if a != largest:
        return None
    counts[a] -= 1
    above = [b + 1 + x for x in _smallest(counts[b + 1 :], 2)]
    counts[a] += 1
    return (a, b) if len(above) < 2 or sum(above) > room else None


def plan_sequences(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that place counts[l] items of each length l, 1 <= l <= capacity.

    Works on the number of items of each length, so its time and memory depend on the capacity alone.
    First, from the longest, sets that provably dominate all alternatives are fixed in bulk: what dominates
    among all items also does among fewer, while its own items last. The remainder is packed by best fit
    in decreasing order.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[Pattern] = []
    for j in range(capacity, 0, -1):
        while left[j]:
            left[j] -= 1
            beside = _dominating(left, j, capacity)
            left[j] += 1
            if beside is None:
                break
            own = (j, *beside)
            n = min(int(left[x]) // own.count(x) for x in set(own))
            patterns.append((n, own))
            for x in own:
                left[x] -= n
    bins: dict[int, list[Pattern]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(room: int, n: int, own: tuple[int, ...]) -> None:
        if not bins[room]:
            insort(rooms, room)
        bins[room].append((n, own))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // length
            if at < len(rooms):
                have, own = bins[room].pop()
                if not bins[room]:
                    rooms.pop(at)
            else:
                have, own = max(1, n // each), ()
            full = min(have, n // each)
            rest = n % each if full < have else 0
            if full:
                put(room - each * length, full, own + (length,) * each)
            if rest:
                put(room - rest * length, 1, own + (length,) * rest)
            if have - full - bool(rest) > 0 and own:
                put(room, have - full - bool(rest), own)
            n -= full * each + rest
    return patterns + [p for own in bins.values() for p in own]


class Encoder:
    """Token ids of whole texts under a tokenizers byte-level BPE .json file, as unsigned 32-bit arrays.

    The file's own vocabulary and split pattern drive a faster merging engine; a text that its pattern engine
    refuses (very long white space) goes through the tokenizers library itself. Tests hold both equal.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, special = byte_alphabet(), {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.library = path, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of `capacity`, of which the first may be shorter."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in sliced(batches):
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                ends = list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity))
                for k, end in enumerate(ends):
                    start = ends[k - 1] if k else 0
                    part = ids[start:end]
                    row = [doc, k, start, end - start, zlib.crc32(part.tobytes())] + [part.tolist()] * with_ids
                    for column, value in zip(rows, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document's tokens in as few sequences of at most `capacity` tokens as the method finds.

    One row per piece: doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32
    (of its ids as little-endian unsigned 32-bit), sequence_id, offset (gapless from 0 in each sequence), and
    `ids` if asked for. A null text is empty, so it is the end id alone. Repeated rows are packed one by one.
    An empty table gives an empty result. Other columns are not read.

    Pieces are written once to the shared folder. Only the number of pieces of each length (at most
    `capacity` numbers) reaches the driver; the plan made of it goes back as a broadcast table whose size is
    bounded by the capacity as well. Pieces find their slot by their rank among those of equal length. A
    length's pieces are ranked in groups of about GROUP_ROWS, dealt by a number of their own, so that a length that very many
    share, even of equal rows, is spread over many tasks.
    """
    spark = docs.sparkSession
    pieces, _ = materialize(tokenized_pieces(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), capacity, end_id, with_ids, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots, following, sequence = [], defaultdict(int), 0
    for n, own in plan_sequences(counts, capacity):
        offset = 0
        for length in own:
            slots.append((length, following[length], following[length] + n, sequence - following[length], offset))
            following[length] += n
            offset += length
        sequence += n
    slots = spark.createDataFrame(slots, "length long, low long, high long, shift long, offset long")
    parts = spark.createDataFrame([(k, n // GROUP_ROWS + 1) for k, n in counts.items()], "length long, parts long")
    order = ["doc_id", "piece", "ids_crc32", "row"]
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64(*order), "parts"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("place", F.row_number().over(W.partitionBy("length", "part").orderBy(*order)) - 1)
    ranked = ranked.join(base, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    s = slots.withColumnRenamed("length", "slot_length")
    placed = ranked.join(F.broadcast(s), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))
