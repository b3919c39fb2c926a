"""Merkle manifest of a dataset: parents keep their children's joined hashes, and leaves read proofs and fold changes out of these."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.runtime import materialize

FANOUT = 16
#: Nodes that one row holds: those of two levels.
BLOCK = FANOUT * FANOUT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGITS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of the fields, each `-` if null, else its UTF-8 byte count, a colon and its text."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where five divides the CRC-32 of the decimal id; null ids and null texts stay."""
    return F.when(F.crc32(doc_id.cast("string")) % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def numbered(leaves: DataFrame, name: str) -> DataFrame:
    """Leaves with their number `pos` in their tree (from 0). leaves: tree, key, hash, uid and more; leaves of a tree
    ascend by key (null first), then hash; equal ones are dealt by uid.

    Leaves are sorted over the whole table by ranges and numbered within ranges by a stream. Only a tree that goes on from the range before has an offset, so there is one
    for each range at most, and these are what is broadcast. Even one tree of all rows, or of equal rows, is spread over the ranges.
    """
    at = leaves.columns.index("tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n, first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column(at)
            change = np.concatenate([[True], pc.not_equal(trees.slice(1), trees.slice(0, len(trees) - 1)).to_numpy(zero_copy_only=False)])
            starts = np.flatnonzero(change)
            goes_on = trees[0].as_py() == tree
            run_of = np.cumsum(change) - 1
            place = np.arange(len(trees)) - starts[run_of] + np.where(run_of == 0, n if goes_on else 0, 0)
            opening = (run_of == 0) & (first and (goes_on or tree is None))
            first = bool(opening[-1])
            tree, n = trees[len(trees) - 1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(opening)], [*batch.schema.names, "place", "opening"])

    schema = leaves.schema.add("place", "long").add("opening", "boolean")
    ordered = leaves.repartitionByRange(F.col("tree"), F.col("key").asc_nulls_first(), F.col("hash"), F.col("uid")).sortWithinPartitions("tree", F.col("key").asc_nulls_first(), "hash", "uid")
    placed, _ = materialize(ordered.mapInArrow(run, schema).withColumn("range", F.spark_partition_id()), name)
    counts = placed.groupBy("tree", "range").agg(F.count("*").alias("n"), F.bool_or("opening").alias("opens"))
    before = F.sum("n").over(W.partitionBy("tree").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("range", "opens", before.alias("offset")).where("opens AND offset IS NOT NULL").select(F.col("range").alias("of"), "offset")
    return placed.join(F.broadcast(offsets), (F.col("range") == F.col("of")) & F.col("opening"), "left").withColumn("pos", F.col("place") + F.coalesce("offset", F.lit(0))).drop("uid", "place", "opening", "range", "of", "offset")


def joined_hashes(hashes: Column) -> Column:
    """The hashes of runs of FANOUT joined: the preimages of their parents."""
    starts = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FANOUT).cast("int"))
    return F.transform(starts, lambda i: F.array_join(F.slice(hashes, i * FANOUT + 1, FANOUT), ""))


def blocks_of(nodes: DataFrame, name: str, *more: str) -> DataFrame:
    """Blocks of BLOCK nodes that follow each other: tree, block (its number), members (structs of pos, hash and more, in order), preimages (of the level above), preimage (of
    the block's node two levels up), hash (of this node, or of the root where the tree ends before) and up (the tree has more blocks). nodes: tree, pos, hash and more.

    Only a tree's first block may be its only one, so only that one looks up how many nodes there are: no key of the join has more than one row.
    """
    totals = nodes.groupBy("tree").agg((F.max("pos") + 1).alias("total")).select("tree", F.lit(0).cast("long").alias("block"), "total")
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash", *more))).alias("members"))
    rows = rows.join(totals, ["tree", "block"], "left").withColumn("total", F.coalesce("total", F.lit(BLOCK + 1)))
    rows = rows.withColumn("preimages", F.when(F.col("total") > 1, joined_hashes(F.transform("members", lambda m: m["hash"]))))
    rows = rows.withColumn("parents", F.transform("preimages", lambda p: F.sha2(p, 256)))
    rows = rows.withColumn("preimage", F.when(F.col("total") > FANOUT, F.array_join("parents", "")))
    hash_ = F.coalesce(F.sha2("preimage", 256), F.col("parents")[0], F.col("members")[0]["hash"])
    return materialize(rows.select("tree", "block", "members", "preimages", "preimage", hash_.alias("hash"), (F.col("total") > BLOCK).alias("up")), name)[0]


STEPS = "array<struct<slot:int,preimage:string>>"


def grow(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The trees over leaves (tree, key, hash, uid and more columns), as the blocks of leaves, of the nodes two levels above, and so on.

    Levels are made two at a time, so n leaves take log256(n) rounds, and an ancestor's preimage is kept once, not once a leaf.
    """
    more = [c for c in leaves.columns if c not in ("tree", "hash", "uid")]
    made = [blocks_of(numbered(leaves, f"{name}-leaves"), f"{name}-0", *more)]
    while not (above := made[-1].where("up")).isEmpty():
        made.append(blocks_of(above.select("tree", F.col("block").alias("pos"), "hash"), f"{name}-{len(made)}"))
    return made


def roots(made: list[DataFrame]) -> DataFrame:
    """tree, hash: each tree's root."""
    out = made[0].where("NOT up").select("tree", "hash")
    for blocks in made[1:]:
        out = out.unionByName(blocks.where("NOT up").select("tree", "hash"))
    return out


def inner_steps(pos: Column) -> Column:
    """Slot and preimage of a member's ancestors within its block, from below."""
    slot, parent = (pos % FANOUT).cast("int"), F.floor(pos % BLOCK / FANOUT).cast("int")
    step = lambda s, p: F.struct(s.alias("slot"), p.alias("preimage"))
    return F.filter(F.array(step(slot, F.col("preimages")[parent]), step(parent, F.col("preimage"))), lambda s: s["preimage"].isNotNull())


def with_paths(made: list[DataFrame], crown: DataFrame | None = None) -> DataFrame:
    """Blocks of leaves with the ancestors above them: path (their preimages, from below, each with the child's slot), subroot (the tree's root) and root.

    crown: tree, steps and root of what the trees themselves are leaves of. Paths are handed down from blocks to blocks, so no key has more than one row.
    """
    above = None
    for blocks in reversed(made):
        ends = blocks.where("NOT up").withColumn("subroot", F.col("hash"))
        if crown is None:
            here = ends.withColumn("path", F.array().cast(STEPS)).withColumn("root", F.col("hash"))
        else:
            here = ends.join(crown.withColumnRenamed("steps", "path"), "tree")
        if above is not None:
            upper = above.select("tree", "subroot", "root", F.explode("members").alias("m"), "preimages", "preimage", "path")
            upper = upper.select("tree", F.col("m.pos").alias("block"), "subroot", F.concat(inner_steps(F.col("m.pos")), "path").alias("path"), "root")
            here = here.unionByName(blocks.where("up").join(upper, ["tree", "block"]))
        above = here
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and a proof of each: doc_id, leaf, subroot (of its source's tree), root (over the sources' subroots), proof_sha256, folded_root, verified.

    A leaf is the hash of the document's fields (`leaf_hash`). Leaves of a source ascend by doc_id, null first, then by hash; repeated rows are leaves of their own. Sources ascend bytewise, null
    first, and one that is null is told from one that is empty. 16 nodes that follow each other become the hash of their joined hashes until one is left. A proof is
    the joined hashes of the leaf's siblings, level by level up to the root; proof_sha256 is its hash. folded_root comes from the leaf of the
    changed document (`tampered`) put in its slot of its parent's preimage, hashed, put in the next, and so on; verified says whether it is the root, so it is false
    just where the change altered the text. Null fields hash as `-`; further columns are not read; an empty table gives no rows.

    Texts are read once, for the two hashes. What is shuffled is a leaf's hashes, ids and source: once to sort, once to gather blocks of 256, which meet their ancestors' preimages
    as a block. No tree is in one task: a source with a third of all rows is sorted by ranges and folded by blocks.
    """
    doc = {c: docs[c] for c in FIELDS}
    own, changed = leaf_hash(list(doc.values())), leaf_hash([tampered(doc["doc_id"], doc["text"]) if c == "text" else doc[c] for c in FIELDS])
    marked = F.crc32(doc["doc_id"].cast("string")) % 5 == 0
    tree = F.coalesce(F.concat(F.lit("s"), doc["source"].cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), doc["doc_id"].cast("long").alias("key"), own.alias("hash"), F.when(marked, changed).alias("changed"), F.monotonically_increasing_id().alias("uid"))
    made = grow(materialize(leaves, "merkle-hashes")[0], "merkle")
    tops = with_paths(grow(roots(made).select(F.lit("").alias("tree"), F.col("tree").alias("key"), "hash", F.lit(0).cast("long").alias("uid")), "merkle-top"))
    crown = tops.select(F.explode("members").alias("m"), "preimages", "preimage", "path", "root")
    crown = crown.select(F.col("m.key").alias("tree"), F.concat(inner_steps(F.col("m.pos")), "path").alias("steps"), "root")
    blocks = with_paths(made, crown).select("members", "preimages", "preimage", "path", "subroot", "root")
    return blocks.mapInArrow(fold_blocks, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def steps_in(pos: int, preimages: list[str] | None, preimage: str | None, path: list[dict]) -> list[tuple[int, str]]:
    """Slot and preimage of each ancestor of a block's node, from below."""
    slot, parent = pos % FANOUT, pos // FANOUT
    steps = [(slot, preimages[parent])] if preimages else []
    if preimage:
        steps.append((parent, preimage))
    return steps + [(s["slot"], s["preimage"]) for s in path]


def fold(leaf: str, steps: list[tuple[int, str]]) -> str:
    """The root that a leaf gives: its hash in place of its slot in the parent's preimage, and so on up."""
    for slot, preimage in steps:
        at = slot * DIGITS
        leaf = hashlib.sha256((preimage[:at] + leaf + preimage[at + DIGITS :]).encode()).hexdigest()
    return leaf


def siblings(steps: list[tuple[int, str]]) -> Iterator[str]:
    """What is left of each preimage when the own slot is cut out."""
    for slot, preimage in steps:
        at = slot * DIGITS
        yield preimage[:at]
        yield preimage[at + DIGITS :]


def fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            out = []
            for member in row["members"]:
                steps = steps_in(member["pos"] % BLOCK, row["preimages"], row["preimage"], row["path"])
                proof = hashlib.sha256()
                for part in siblings(steps):
                    proof.update(part.encode())
                folded = fold(member["changed"] or member["hash"], steps)
                out.append((member["key"], member["hash"], row["subroot"], row["root"], proof.hexdigest(), folded, folded == row["root"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB's SQL: bit by bit."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "xor(c, s)"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda c: {step})[1]"
    codes = f"list_transform(string_split({text}, ''), lambda d: ascii(d)::UBIGINT)"
    return f"xor(list_reduce({codes}, lambda c, s: {byte}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


def oracle_sql(source_levels: int = 5, top_levels: int = 3) -> str:
    """The manifest in DuckDB's SQL, written for sources of at most 16 ** source_levels documents and 16 ** top_levels sources."""
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, FIELDS[:4]), part(text)]) + ")"
    sql = f"""WITH hashed AS MATERIALIZED (
  SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf("text")} END AS changed FROM documents
), node0 AS MATERIALIZED (SELECT doc_id, source, leaf, changed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS hash FROM hashed
), tree0 AS MATERIALIZED (SELECT source, pos, hash FROM node0
), path0 AS MATERIALIZED (SELECT doc_id, source, leaf, pos, changed AS folded, '' AS proof, NULL::VARCHAR AS subroot FROM node0"""

    def level(k: int, own: str, key: str) -> str:
        on = f"p.{own}pos // 16 = t.pos" + (f" AND p.source IS NOT DISTINCT FROM t.{key}" if key else "")
        slot = f"64 * (p.{own}pos % 16)"
        return f"""
), tree{k + 1} AS MATERIALIZED (
  SELECT {key + "," if key else ""} place // 16 AS pos, string_agg(hash, '' ORDER BY place) AS preimage, max(many) AS many, CASE WHEN max(many) THEN sha256(string_agg(hash, '' ORDER BY place)) ELSE max(hash) END AS hash
  FROM (SELECT {key + "," if key else ""} hash, pos AS place, count(*) OVER ({"PARTITION BY " + key if key else ""}) > 1 AS many FROM tree{k}) GROUP BY ALL
), path{k + 1} AS MATERIALIZED (
  SELECT p.* EXCLUDE ({own}pos, folded, proof), p.{own}pos // 16 AS {own}pos,
         CASE WHEN many THEN sha256(left(preimage, {slot}) || folded || substr(preimage, {slot} + 65)) ELSE folded END AS folded,
         CASE WHEN many THEN proof || left(preimage, {slot}) || substr(preimage, {slot} + 65) ELSE proof END AS proof
  FROM path{k} p JOIN (SELECT {key + "," if key else ""} pos, preimage, many FROM tree{k + 1}) t ON {on}"""

    for k in range(source_levels):
        sql += level(k, "", "source").replace("GROUP BY ALL", "GROUP BY source, place // 16")
    k = source_levels
    sql += f"""
), tree{k + 1} AS MATERIALIZED (SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree{k}
), path{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (subroot), t.hash AS subroot, t.pos AS top_pos FROM path{k} p JOIN tree{k + 1} t ON p.source IS NOT DISTINCT FROM t.source"""
    for k in range(source_levels + 1, source_levels + 1 + top_levels):
        sql += level(k, "top_", "").replace("GROUP BY ALL", "GROUP BY place // 16")
    k += 1
    return sql + f"""
)
SELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = hash AS verified FROM path{k}, (SELECT hash FROM tree{k}) r"""
