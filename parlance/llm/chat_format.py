"""Chat formatting by prefix-target expansion: every assistant turn is an example whose context is all turns before it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.runtime import materialize, sliced

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a model or another template may read as control; "<|" and "|>" cover this template's own marks.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
#: Turn numbers that one task orders together at most, for each conversation.
CHUNK = 256
#: Code points of a conversation that a part of a written example spans at most, but for the turn that it ends in.
PART = 1 << 16


def escape(text: Column) -> Column:
    """Double backslashes, then put one behind the first character of every control string."""
    any_of = "|".join("".join(c if c.isalnum() else "\\" + c for c in s) for s in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?=(?:{any_of}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_targets(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The formatted turns of every conversation, and in them every assistant turn as an example.

    One row per turn: conv_id, position (from 0), role, piece (the turn between its marks, control strings of role and
    text escaped reversibly), context_chars (code points of the conversation's pieces before it), piece_chars,
    example (number of the assistant turn in its conversation, null for other turns), loss_start and loss_end
    (code points of the conversation's joined pieces that are trainable: the assistant's text alone; null for
    other turns). An example's text is its conversation's pieces joined, cut after its own: the first
    context_chars code points are context. So n examples of a conversation share one copy of its turns, where
    writing each out would grow with the square of n; `expand` writes them out.

    Turns follow each other by turn (null first), then role and text; equal rows are kept. Null texts and roles are
    empty; rows with a null conv_id form a conversation. Turns are ordered within chunks of turn numbers, and only a row for each
    chunk is ordered for the whole conversation, so one endless conversation is spread over many tasks.
    """
    text, role = F.coalesce(turns["text"].cast("string"), F.lit("")), F.coalesce(turns["role"].cast("string"), F.lit(""))
    base = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    base = base.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 62))))
    base = base.select("*", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"))
    base = base.withColumn("target", (F.col("role") == "assistant").cast("long"))
    base = base.withColumn("piece", F.concat("head", "body", F.lit(END))).withColumn("chars", F.char_length("piece").cast("long"))
    sums = base.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("target").alias("targets"))
    earlier = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"before_{x}") for x in ("n", "chars", "targets")])
    inside = W.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(W.unboundedPreceding, -1)
    upto = lambda x: F.coalesce(F.sum(x).over(inside), F.lit(0))
    placed = base.select("*", upto(F.lit(1)).alias("n"), upto("chars").alias("in_chars"), upto("target").alias("in_targets"))
    placed = placed.join(before, placed["conv_id"].eqNullSafe(before["c"]) & (placed["chunk"] == before["k"]))
    context, is_target = F.col("before_chars") + F.col("in_chars"), F.col("target") == 1
    start = context + F.char_length("head")
    return placed.select(
        "conv_id",
        (F.col("before_n") + F.col("n")).alias("position"),
        "role",
        "piece",
        context.alias("context_chars"),
        F.col("chars").alias("piece_chars"),
        F.when(is_target, F.col("before_targets") + F.col("in_targets")).alias("example"),
        F.when(is_target, start).alias("loss_start"),
        F.when(is_target, start + F.char_length("body")).alias("loss_end"),
    )


def expand(examples: DataFrame, block: int = 256) -> DataFrame:
    """Examples written out, each in order of its parts, a turn a part: conv_id, example, part (from 0), text, trainable (the part holds the
    reply), loss_start and loss_end (code points of the example's joined parts). Nothing is cut or left out, however long a conversation.

    n examples of a conversation have its turns n / 2 times, which is what writing them out means; they are
    made in blocks of examples, so that no task has all of a long conversation's.
    """
    targets = examples.where("example IS NOT NULL").select(F.col("conv_id").alias("c"), "example", F.col("position").alias("upto"), "loss_start", "loss_end", F.floor(F.col("example") / block).alias("block"))
    blocks = targets.groupBy("c", "block").agg(F.max("upto").alias("last")).select(F.col("c").alias("of"), F.col("block").alias("dealt"), "last")
    dealt = examples.select("conv_id", "position", "piece").join(blocks, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("position") <= F.col("last")))
    made = dealt.join(targets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("dealt") == F.col("block")) & (F.col("position") <= F.col("upto")))
    return made.select("conv_id", "example", F.col("position").alias("part"), F.col("piece").alias("text"), (F.col("position") == F.col("upto")).alias("trainable"), "loss_start", "loss_end")


def write_examples(turns: DataFrame, size: int = PART) -> DataFrame:
    """Examples written out, each in order of its parts, many turns a part: conv_id, example, part (ascending), text, context_chars, loss_start and
    loss_end. turns: rows of `prefix_targets`. An example's joined parts are all turns up to its own, and nothing after.

    Turns that begin in the same `size` code points of their conversation are joined once, to a block. A part is such a block, the last one cut after the
    example's turn. So rows grow with the examples, and no row holds more than a block and a turn, however long a conversation.
    """
    placed = turns.withColumn("block", F.floor(F.col("context_chars") / size))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda x: x["piece"]), "")
    blocks = placed.groupBy("conv_id", "block").agg(F.min("context_chars").alias("from"), whole.alias("held"))
    upto = (F.col("context_chars") + F.col("piece_chars")).alias("upto")
    targets = placed.where("example IS NOT NULL").select(F.col("conv_id").alias("c"), "example", "context_chars", "loss_start", "loss_end", F.col("block").alias("last"), upto)
    made = targets.join(blocks.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") <= F.col("last")))
    text = F.when(F.col("block") < F.col("last"), F.col("held")).otherwise(F.substr("held", F.lit(1), (F.col("upto") - F.col("from")).cast("int")))
    return made.select("conv_id", "example", F.col("block").alias("part"), text.alias("text"), "context_chars", "loss_start", "loss_end")


def read_examples(written: DataFrame) -> DataFrame:
    """conv_id, example, reply (the text under the loss mask, unescaped) and context_sha256 (of role, newline, text, newline of each turn before it), as
    read from the example's own text. Parts are streamed; what lies between loss_start and loss_end is the reply, what lies before context_chars the context,
    whose turns are found by their marks."""
    turn = re.compile(f"(?s){re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}")
    plain = lambda s: re.sub(r"(?s)\\(.)", r"\1", s) if "\\" in s else s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["conv_id", "example", "reply", "context_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
        key, at, context, reply, done = None, 0, hashlib.sha256(), [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

        for batch in sliced(batches):
            for conv, example, text, context_chars, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (conv, example):
                    if key is not None:
                        done.append((*key, plain("".join(reply)), context.hexdigest()))
                    key, at, context, reply = (conv, example), 0, hashlib.sha256(), []
                before, read = text[: max(context_chars - at, 0)], 0
                for found in turn.finditer(before):
                    context.update(f"{plain(found[1])}\n{plain(found[2])}\n".encode())
                    read += len(found[0])
                if read != len(before):  # the context ends within a turn
                    context.update(f"not whole turns: {len(before)}".encode())
                reply.append(text[max(start - at, 0) : max(end - at, 0)])
                at += len(text)
            if done:
                yield out()
                done = []
        if key is not None:
            done.append((*key, plain("".join(reply)), context.hexdigest()))
            yield out()

    ordered = written.repartition("conv_id", "example").sortWithinPartitions("conv_id", "example", "part").select("conv_id", "example", "text", "context_chars", "loss_start", "loss_end")
    return ordered.mapInArrow(run, "conv_id long, example long, reply string, context_sha256 string")


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of every conversation: conv_id, n_turns, turns_sha256 (of role, newline, text, newline a turn), loss_chars, loss_sha256 (of the text under
    the loss masks, unescaped), formatted_chars, n_examples and contexts_sha256 (of the digests of all examples' contexts, each of what its turns say).
    turns: rows of `prefix_targets`.

    Every assistant turn is written out as an example with all turns before it (`write_examples`), and loss and contexts are read from the examples' own text
    (`read_examples`): where a prefix or a mask is wrong, the digests differ. The turns themselves, those after the last reply among them, are read from the
    formatted conversation. A hash runs through a conversation in order; a task streams it row by row and holds only its state.
    """
    turns, _ = materialize(turns, "chat-turns")
    mark = lambda s: re.escape(s)
    form = f"(?s)^{mark(TURN)}(.*?){mark(TEXT)}(.*){mark(END)}$"
    said = F.concat(unescape(F.regexp_extract("piece", form, 1)), F.lit("\n"), unescape(F.regexp_extract("piece", form, 2)), F.lit("\n"))
    formatted = turns.select("conv_id", "position", said.alias("text"), F.char_length("piece").cast("long").alias("chars"), F.lit(None).cast("string").alias("context"))
    examples = read_examples(write_examples(turns)).select("conv_id", "example", "reply", F.lit(None).cast("long"), "context_sha256")
    rows = formatted.union(examples).withColumn("read", F.col("context").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "contexts_sha256"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        state, key, done = None, None, []

        def finished() -> list:
            turns, said, loss, chars, at, n, contexts = state
            return [key, turns, said.hexdigest(), chars, loss.hexdigest(), at, n, contexts.hexdigest()]

        for batch in batches:
            for conv, text, chars, context in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != key:
                    if state is not None:
                        done.append(finished())
                    state, key = [0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, hashlib.sha256()], conv
                if context is None:
                    state[0] += 1
                    state[1].update(text.encode())
                    state[4] += chars
                else:
                    state[2].update(text.encode())
                    state[3] += len(text)
                    state[5] += 1
                    state[6].update(context.encode())
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
                done = []
        if state is not None:
            done.append(finished())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "read", "position").select("conv_id", "text", "chars", "context")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, contexts_sha256 string")


def _escaped_length(column: str) -> str:
    marks = " + ".join(f"(length({column}) - length(replace({column}, '{s}', ''))) // {len(s)}" for s in (*CONTROL, "\\"))
    return f"length({column}) + {marks}"


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, role || chr(10) || text || chr(10) AS said FROM turns
), contexts AS (
  SELECT a.conv_id, a.p, sha256(coalesce(string_agg(b.said, '' ORDER BY b.p), '')) AS context
  FROM placed a LEFT JOIN placed b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.p < a.p WHERE a.role = 'assistant' GROUP BY a.conv_id, a.p
), joined AS (SELECT conv_id, sha256(string_agg(context, '' ORDER BY p)) AS contexts_sha256 FROM contexts GROUP BY conv_id
), digests AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said, '' ORDER BY p)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
         sum({len(TURN + TEXT + END)} + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars,
         count(*) FILTER (WHERE role = 'assistant') AS n_examples
  FROM placed GROUP BY conv_id
)
SELECT d.*, coalesce(contexts_sha256, sha256('')) AS contexts_sha256 FROM digests d LEFT JOIN joined j ON d.conv_id IS NOT DISTINCT FROM j.conv_id
"""
