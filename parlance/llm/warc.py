"""WARC archives of pages: written with revisits of equal payloads, and read back by chains of record boundaries from the start of each file."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.runtime import HOT, fresh_path, materialize, sliced

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
#: Fixed value of the format: what a revisit of an equal payload calls itself.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Rows of a table that is broadcast at most, of some 150 bytes each.
SMALL = 100_000


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base32 of a SHA-1 in hexadecimal digits: ten of them are eight letters."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_originals(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with what `repeated` knows of their key, or nulls. Keys of very many rows are broadcast, of which there are few by definition; the others too where they
    are few, else rows are shuffled by key."""
    if repeated.count() <= SMALL:
        return rows.join(F.broadcast(repeated), "key", "left")
    hot = F.broadcast(repeated.where(F.col("n") > max(HOT, rows.count() // 10_000)))
    return rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(repeated, "key", "left"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages (page_id, url, html) into WARC files in a new folder `path`, one file a task.

    A record's payload is the html in UTF-8 (null: empty), behind an HTTP header. Of the rows with equal payloads of at least min_bytes bytes the one with the largest
    page_id (null is smallest; of equal ones any) is the response, and the others are revisits that refer to it and have no payload; smaller payloads are all responses. Payloads are equal
    if their SHA-1 and XXH64 are. Null urls and ids have no header line; line ends in urls are percent-encoded. Repeated rows are records of their own. An empty table gives no files of note.
    Pages are read twice: for the digests, then to write; html is shuffled only where more than SMALL payloads repeat.
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"))
    rows = rows.select("page_id", F.xxhash64("url").alias("of_url"), F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("size"), F.xxhash64("html").alias("xx"), "url", "html")
    rows = rows.select("page_id", "of_url", F.concat("sha1", F.lit("-"), F.lower(F.hex("xx"))).alias("key"), "sha1", "size", "url", "html")
    each = rows.where(F.col("size") >= min_bytes).groupBy("key", "page_id", "of_url").agg(F.count("*").alias("same"))
    top = F.max(F.struct("page_id", "of_url", "same"))
    repeated = each.groupBy("key").agg(top.alias("top"), F.sum("same").alias("n")).where("n > 1")
    repeated, _ = materialize(repeated.select("key", F.col("top.page_id").alias("top_page"), F.col("top.of_url").alias("top_url"), F.col("top.same").alias("same"), "n"), "warc-repeated")
    known = with_originals(rows, repeated)
    is_top = F.col("page_id").eqNullSafe(F.col("top_page")) & (F.col("of_url") == F.col("top_url"))
    known = known.withColumn("role", F.when(F.col("n").isNull(), "response").when(~is_top, "revisit").when(F.col("same") > 1, "tied").otherwise("response"))
    records = known.where("role <> 'tied'").withColumn("alone", F.col("n").isNull() & (F.col("size") < min_bytes)).select(record(date))
    if not repeated.where("same > 1").isEmpty():
        # rows that are equal in page_id, url and html: one of them is the response, and the rest are told by their number
        first = known.where("role = 'tied'").dropDuplicates(["key"]).withColumn("alone", F.lit(False))
        rest = first.select("page_id", "key", "sha1", "size", "url", "top_page", "alone", F.explode(F.sequence(F.lit(2).cast("long"), "same")).alias("copy")).repartition("copy")
        records = records.unionByName(first.withColumn("role", F.lit("response")).select(record(date)))
        records = records.unionByName(rest.withColumn("role", F.lit("revisit")).withColumn("html", F.lit("")).select(record(date)))
    records.write.option("lineSep", GAP).text(path)


def record(date: str) -> Column:
    """A record up to the empty lines that end it, which the writer adds."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("role") == "revisit"
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    own = F.when(revisit | F.col("alone"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).otherwise(F.concat(F.lit("<urn:page:"), number("page_id"), F.lit(":"), "key", F.lit(">")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(GAP))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), number("top_page"), F.lit(":"), "key", F.lit(">")))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    ).alias("value")


class Payload:
    """Takes a record's block in parts: the length and digest of what follows its HTTP header, and the length that this header tells."""

    def __init__(self, length: int) -> None:
        self.left, self.head, self.sha, self.size, self.told = length, b"", None, 0, None

    def feed(self, part: bytes) -> None:
        part = part[: self.left]
        self.left -= len(part)
        if self.sha is None:
            part = self.head + part
            end = part.find(b"\r\n\r\n")
            if end < 0:
                self.head = part
                return
            told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", part[:end])
            self.told = int(told[1]) if told else None
            self.head, self.sha, part = b"", hashlib.sha1(), part[end + 4 :]
        self.sha.update(part)
        self.size += len(part)

    def digest(self) -> str | None:
        return None if self.sha is None or self.left else base64.b32encode(self.sha.digest()).decode()


def headers(piece: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """The header lines after a magic, in lower case, with where the block begins and how long it is; None if this is no record's header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = dict(line.split(b":", 1) if b":" in line else (line, b"") for line in piece[:end].split(b"\r\n"))
    lines = {k.strip().lower(): v.strip() for k, v in lines.items()}
    length = lines.get(b"content-length", b"")
    return (lines, end + 4, int(length)) if re.fullmatch(rb"[0-9]{1,18}", length) else None


def scan(spark: SparkSession, path: str) -> DataFrame:
    """What lies between the magics of the files in a folder: file, split, value. Spark splits the files; the pieces of a split follow each other."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("value"))


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(file, split, file size, at, piece) of each piece; at: where its magic begins, counted from where the split's first piece does."""
    key, at = None, 0
    for batch in batches:
        for part in sliced([batch]):
            for file, split, size, value in zip(*(c.to_pylist() for c in part.columns)):
                if (file, split) != key:
                    key, at = (file, split), 0
                yield file, split, size, at - len(MAGIC), value
                at += len(value) + len(MAGIC)


FIELDS = [("file", pa.int64()), ("split", pa.int64()), ("file_size", pa.int64()), ("at", pa.int64()), ("length", pa.int64()), ("to", pa.int64()), ("whole", pa.bool_()), ("kind", pa.string()), ("page_id", pa.int64()), ("told_digest", pa.string()), ("refers", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("leaves", pa.int64())]
FIELDS_DDL = "file long, split long, file_size long, at long, length long, to long, whole boolean, kind string, page_id long, told_digest string, refers string, size long, digest string, leaves long"


def batch_of(rows: list[tuple], fields: list[tuple] = FIELDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def chain_ends(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where each candidate's chain leaves the split: pointers to successors within it, jumped over until none moves."""
    if not len(at):
        return to
    found = np.minimum(np.searchsorted(at, to), len(at) - 1)
    jump = np.where(at[found] == to, found, np.arange(len(at)))
    while (further := jump[jump]).tolist() != jump.tolist():
        jump = further
    return to[jump]


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece: its place, and if it reads as a record's header, its successor's offset and what the record says. At the end of each split,
    a row for each candidate with where its chain leaves the split. A task holds two numbers for each candidate of a split."""
    key, out, at_, to_, size_ = None, [], array("q"), array("q"), 0

    def leave() -> Iterator[pa.RecordBatch]:
        ends = chain_ends(np.array(at_, np.int64), np.array(to_, np.int64))
        for a in range(0, len(ends), 1 << 16):
            rows = [(*key, size_, at, None, None, None, None, None, None, None, None, None, end) for at, end in zip(at_[a : a + (1 << 16)], ends[a : a + (1 << 16)].tolist())]
            yield batch_of(rows)

    for file, split, size, at, piece in placed(batches):
        if (file, split) != key:
            if key is not None:
                yield from leave()
            key, at_, to_, size_ = (file, split), array("q"), array("q"), size
        read = headers(piece) if split or at >= 0 else None
        if read is None:
            out.append((file, split, size, at, len(piece), *[None] * 9))
        else:
            lines, begins, length = read
            to = at + len(MAGIC) + begins + length + len(GAP)
            at_.append(at)
            to_.append(to)
            page = lines.get(b"x-page-id", b"")
            page = int(page) if re.fullmatch(rb"-?[0-9]{1,19}", page) else None
            whole, payload = begins + length + len(GAP) <= len(piece), Payload(length)
            if whole:
                payload.feed(piece[begins : begins + length])
            said = [lines[k].decode("utf-8", "replace") if k in lines else None for k in (b"warc-type", b"warc-payload-digest", b"warc-refers-to")]
            size_of = payload.told if said[0] == "revisit" else payload.size
            out.append((file, split, size, at, len(piece), to, whole, said[0], page if page is not None and -(1 << 63) <= page < 1 << 63 else None, said[1], said[2], size_of, payload.digest(), None))
        if len(out) >= 10_000:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)
    if key is not None:
        yield from leave()


def reachable(entries: DataFrame) -> DataFrame:
    """file, at: the candidates at which chains from their file's start come into a split. entries: file, at, leaves, of the candidates at which a chain
    may come in. Pointers are doubled each round, so files of n splits take log2(n) rounds."""
    reached, _ = materialize(entries.where("at = 0").select("file", "at"), "warc-reached")
    jumps = entries.join(entries.select("file", F.col("at").alias("leaves")), ["file", "leaves"], "left_semi").select("file", "at", F.col("leaves").alias("jump"))
    jumps, _ = materialize(jumps, "warc-jumps")
    n = reached.count()
    while True:
        more, _ = materialize(reached.unionByName(reached.join(jumps, ["file", "at"]).select("file", F.col("jump").alias("at"))).distinct(), "warc-reached")
        if (now := more.count()) == n:
            return more
        reached, n = more, now
        jumps, _ = materialize(jumps.join(jumps.select("file", F.col("at").alias("jump"), F.col("jump").alias("further")), ["file", "jump"]).select("file", "at", F.col("further").alias("jump")), "warc-jumps")


def mark(pieces: DataFrame) -> DataFrame:
    """pieces (file, split, at, to, entry and more) with reached (the piece begins a record on the chain from the file's start) and owner (where the record that it
    belongs to begins; null before the split's first). Streams each split in order."""
    at, to, entry, file, split = (pieces.columns.index(c) for c in ("at", "to", "entry", "file", "split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, expected, owner = None, None, None
        for batch in batches:
            reached, owners = [], []
            for row in zip(*(batch.column(i).to_pylist() for i in (file, split, at, to, entry))):
                if row[:2] != key:
                    key, expected, owner = row[:2], row[4], None
                hit = row[2] == expected and row[3] is not None
                if hit:
                    expected, owner = row[3], row[2]
                reached.append(hit)
                owners.append(owner)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reached, pa.bool_()), pa.array(owners, pa.int64())], [*batch.schema.names, "reached", "owner"])

    ordered = pieces.repartition("file", "split").sortWithinPartitions("file", "split", "at")
    return ordered.mapInArrow(run, pieces.schema.add("reached", "boolean").add("owner", "long"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files in a folder: page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the record that a revisit refers to)
    and intact (the payload has the digest that its header tells; null for revisits, of which there is no payload).

    The string that begins a record may stand in payloads too, whole records even. So tasks read whatever follows such a string as a candidate and note where its
    successor would begin; a chain of these from the start of a file meets the records alone. Within a split of a file pointers are jumped over by the task; the few that
    lead from split to split are jumped over by joins, doubled each round. A piece of a payload that holds the string is put together again from what lies between the record and its successor: only those pieces are
    read a second time and shuffled. Digests and lengths come from the payloads themselves, those of revisits from their headers. A file whose chain stops before its end
    is damaged: a ValueError tells how many are. A folder without records gives an empty table.
    """
    made, _ = materialize(scan(spark, path).mapInArrow(candidates, FIELDS_DDL), "warc-pieces")
    pieces, chains = made.where("length IS NOT NULL").drop("leaves"), made.where("leaves IS NOT NULL").select("file", "split", "at", "leaves")
    before = F.coalesce(F.sum("bytes").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = pieces.groupBy("file", "split").agg(F.sum(F.col("length") + len(MAGIC)).alias("bytes"))
    bases, _ = materialize(sizes.select("file", "split", before.alias("base")), "warc-splits")
    chains = chains.join(bases, ["file", "split"]).select("file", "split", (F.col("at") + F.col("base")).alias("at"), (F.col("leaves") + F.col("base")).alias("leaves"))
    ways_in = chains.select("file", F.col("leaves").alias("at")).distinct()
    entries, _ = materialize(chains.where("at = 0").unionByName(chains.where("at > 0").join(ways_in, ["file", "at"], "left_semi")), "warc-entries")
    found = reachable(entries.select("file", "at", "leaves")).join(entries.select("file", "at", "split"), ["file", "at"]).select("file", "split", F.col("at").alias("entry"))
    known = pieces.join(bases, ["file", "split"]).join(found, ["file", "split"], "left")
    known = known.withColumn("at", F.col("at") + F.col("base")).withColumn("to", F.col("to") + F.col("base"))
    marked, _ = materialize(mark(known), "warc-marked")
    records = marked.where("reached")
    ends = marked.groupBy("file").agg(F.max("file_size").alias("file_size"), F.coalesce(F.max(F.when(F.col("reached"), F.col("to"))), F.lit(0)).alias("end"))
    if damaged := ends.where("end <> file_size").count():
        raise ValueError(f"{damaged} archives in {path} are damaged: their chains of records stop before their ends")
    split_up = records.where("NOT whole").select("file", F.col("at").alias("owner"))
    if not split_up.isEmpty():
        again = put_together(spark, path, marked, split_up)
        records = records.drop("size", "digest").join(again.withColumnRenamed("owner", "at"), ["file", "at"], "inner").unionByName(records.where("whole").select([c for c in records.columns if c not in ("size", "digest")] + ["size", "digest"]))
    bare = lambda c: F.regexp_replace(c, "^sha1:", "")
    revisit = F.col("kind") == "revisit"
    return records.select(
        "page_id",
        F.col("size").alias("payload_bytes"),
        F.when(revisit, bare(F.col("told_digest"))).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, F.regexp_extract("refers", "^<urn:page:(-?[0-9]+):", 1).try_cast("long")).alias("refers_to"),
        F.when(~revisit, bare(F.col("told_digest")) == F.col("digest")).alias("intact"),
    )


def put_together(spark: SparkSession, path: str, marked: DataFrame, split_up: DataFrame) -> DataFrame:
    """file, owner, size, digest of the records whose payloads hold the magic. Their pieces are streamed in order, so a payload need not fit a task."""
    last = F.last("own", ignorenulls=True).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    carried = marked.groupBy("file", "split").agg(F.max("owner").alias("own")).select("file", "split", last.alias("carried"))
    owned = marked.join(carried, ["file", "split"]).withColumn("owner", F.coalesce("owner", "carried"))
    parts = owned.join(split_up, ["file", "owner"], "left_semi").select("file", "split", (F.col("at") - F.col("base")).alias("at"), "base", "owner")
    parts, _ = materialize(parts, "warc-parts")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, out, held = [("file", pa.int64()), ("split", pa.int64()), ("at", pa.int64()), ("value", pa.binary())], [], 0
        for file, split, _, at, value in placed(batches):
            out.append((file, split, at, value))
            held += len(value)
            if held > 1 << 23 or len(out) >= 10_000:
                yield batch_of(out, fields)
                out, held = [], 0
        if out:
            yield batch_of(out, fields)

    again = scan(spark, path).mapInArrow(pieces, "file long, split long, at long, value binary")
    wanted = F.broadcast(parts) if parts.count() <= SMALL else parts
    taken = again.join(wanted, ["file", "split", "at"]).select("file", "owner", (F.col("at") + F.col("base")).alias("at"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, key, payload, kind, out = [("file", pa.int64()), ("owner", pa.int64()), ("size", pa.int64()), ("digest", pa.string())], None, None, None, []
        told = lambda: (*key, payload.told if kind == b"revisit" else payload.size, payload.digest())
        for batch in batches:
            for file, owner, value in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (file, owner) != key:
                    if key is not None:
                        out.append(told())
                    key = (file, owner)
                    lines, begins, length = headers(value)
                    payload, kind, value = Payload(length), lines.get(b"warc-type"), value[begins:]
                else:
                    value = MAGIC.encode() + value
                payload.feed(value)
        if key is not None:
            out.append(told())
        if out:
            yield batch_of(out, fields)

    return taken.repartition("file", "owner").sortWithinPartitions("file", "owner", "at").mapInArrow(run, "file long, owner long, size long, digest string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of pages, in the shared folder, read back (see `write_archives` and `read_archives`). They are taken away when the driver ends."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)


ORACLE = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), placed AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, hex, row_number() OVER w AS place, first_value(page_id) OVER w AS top
  FROM sized WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST)
)
SELECT page_id, payload_bytes,
       translate(array_to_string(list_transform(range(4), lambda i: to_base(('0x' || substr(hex, (10 * i + 1)::BIGINT, 10))::BIGINT, 32, 8)), ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN top END AS refers_to,
       CASE WHEN place = 1 THEN true END AS intact
FROM placed
"""
