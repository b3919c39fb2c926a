"""Mixing sources to target weights by hierarchical budgets, all in DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.runtime import materialize

LEVELS = ("domain", "lang", "source")
#: Up to so many leaves the leaf table (some 100 bytes a row) is broadcast; beyond, it is joined without a hint.
BROADCAST_LEAVES = 50_000
WHOLE = "decimal(38,0)"
#: Hexadecimal digits of the order key by which a leaf's tokens are summed: 4,096 sums for each leaf at most.
DIGITS = 3


@dataclass(frozen=True)
class Mixture:
    """Target weights (whole numbers; a name that is not listed has `other`) at each level of the domain-language-source tree.

    domains: domain of each source. percent: the token budget as a percentage of all tokens there are.
    max_epochs: times that a document may be used at most.
    """

    domains: dict[str, str] = field(default_factory=lambda: {"src0": "crawl"} | {f"src{i}": "reference" for i in range(1, 7)})
    default_domain: str = "community"
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"crawl": 2, "reference": 5, "community": 3}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {}})
    other: int = 1
    percent: int = 60
    max_epochs: int = 3
    seed: int = 7


def _look_up(column: Column, values: dict, default: Column) -> Column:
    if not values:
        return default
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[column], default)


def tokens(text: Column) -> Column:
    """A token estimate that needs no tokenizer: a quarter of the bytes, rounded up; null has none."""
    return F.coalesce(F.shiftright(F.octet_length(text).cast("long") + 3, 2), F.lit(0).cast("long"))


def share_out(nodes: DataFrame, level: int) -> DataFrame:
    """Give each node of a level, whose parents have budgets, its own: column `budget`.

    nodes: the level's keys, w (weight), cap (capacity) and above (the parent's budget). Water-filling among siblings: a node
    gets its weight's share, but at most its capacity, and what it can't use goes to its siblings by their weights. In
    ascending order of capacity for each weight, filled nodes come first; sums before and behind a node tell
    whether it is one. As no parent gets more than its children can hold, a shortage reaches other branches of an
    ancestor only where siblings can't take it. Nodes of weight zero get nothing.
    """
    keys = list(LEVELS[: level + 1])
    by = W.partitionBy(*(LEVELS[:level] or [F.lit(0)]))
    ordered = by.orderBy((F.col("cap").cast("double") / F.when(F.col("w") > 0, F.col("w")).cast("double")).asc_nulls_last(), *keys)
    out = nodes.withColumn("before", F.coalesce(F.sum("cap").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast(WHOLE)))
    out = out.withColumn("behind", F.sum("w").over(ordered.rowsBetween(W.currentRow, W.unboundedFollowing)))
    out = out.withColumn("full", F.expr("w > 0 AND cap * behind <= (above - before) * w"))
    out = out.withColumn("rest", F.col("above") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)))
    out = out.withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(by))
    own = F.expr("CASE WHEN full THEN cap WHEN open > 0 THEN (rest * w) div open ELSE 0 END")
    return out.select(*keys, own.cast(WHOLE).alias("budget"))


def leaves_of(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """Leaf columns, the token estimate and the order key of every row, beside the row's own columns.

    Names begin with __mix_, so columns of the input can't clash. Null languages and sources are leaves called ''.
    """
    source, lang = F.coalesce(docs["source"].cast("string"), F.lit("")), F.coalesce(docs["lang"].cast("string"), F.lit(""))
    return docs.select(
        "*",
        _look_up(source, mixture.domains, F.lit(mixture.default_domain)).alias("__mix_domain"),
        lang.alias("__mix_lang"),
        source.alias("__mix_source"),
        tokens(docs["text"].cast("string")).alias("__mix_tokens"),
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("__mix_id"),
    )


LEAF = [f"__mix_{k}" for k in LEVELS]


def budgets(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """One row for each leaf: its keys, tokens there are, budget, whole epochs and tokens of the last, partial epoch."""
    leaves = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(LEAF, LEVELS)]).agg(F.sum("__mix_tokens").cast(WHOLE).alias("there"))
    weight = lambda k: _look_up(F.col(k), mixture.weights.get(k, {}), F.lit(mixture.other)).cast(WHOLE)
    alive = F.least(*[weight(k) for k in LEVELS]) > 0
    nodes = leaves.withColumn("cap", F.when(alive, F.col("there") * mixture.max_epochs).otherwise(0).cast(WHOLE))
    totals = [F.sum("cap").cast(WHOLE).alias("cap"), F.sum("there").cast(WHOLE).alias("there")]
    sums = [nodes.groupBy(*LEVELS[: i + 1]).agg(*totals).withColumn("w", F.when(F.col("cap") > 0, weight(LEVELS[i])).otherwise(0).cast(WHOLE)) for i in range(3)]
    everything = W.partitionBy(F.lit(0))
    top = sums[0].withColumn("all", F.sum("there").over(everything)).withColumn("holds", F.sum("cap").over(everything))
    given = share_out(top.withColumn("above", F.expr(f"least(all * {mixture.percent} div 100, holds)").cast(WHOLE)), 0)
    for i in (1, 2):
        given = share_out(sums[i].drop("there").join(given.withColumnRenamed("budget", "above"), list(LEVELS[:i])), i)
    out = leaves.join(given, list(LEVELS))
    return out.select(*LEVELS, "there", "budget", F.expr("CASE WHEN there > 0 THEN budget div there ELSE 0 END").cast("int").alias("full")).withColumn("rest", F.expr("budget - full * there").cast(WHOLE))


def mix(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The rows that the mixture takes, each once for every epoch that uses it, with their own columns and
    __mix_domain, __mix_lang, __mix_source, __mix_tokens and __mix_epoch.

    A leaf's documents follow each other, in epoch e, by the MD5 of seed, e and doc_id; the leaf takes whole epochs while its
    budget lasts and of the last the longest prefix within the rest. Rows with equal doc_id share a place and are
    taken together. No leaf is sorted whole: sums by the key's first digits, one more at a time, find the one part that holds the
    end of the prefix, and only that part's keys are ordered, to give a threshold for each leaf. The rows themselves
    are never shuffled if the leaves, whose number is counted, are few enough to broadcast; else they are joined to them.
    Null texts have no tokens; nulls in doc_id, lang and source count as ''. An empty table gives an empty result.
    """
    rows = leaves_of(docs, mixture)
    leaves, _ = materialize(budgets(rows, mixture), "leaves")
    few = leaves.count() <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda df: df)
    on = lambda right: [F.col(c) == right[k] for c, k in zip(LEAF, LEVELS)]
    place = lambda full: F.md5(F.concat_ws(":", F.lit(str(mixture.seed)), F.col(full).cast("string"), F.col("__mix_id")))
    narrow = rows.select(*LEAF, "__mix_tokens", "__mix_id").join(small(leaves), on(leaves)).select(*LEVELS, "rest", F.col("__mix_tokens").alias("n"), place("full").alias("place"))
    by = W.partitionBy(*LEVELS)
    parts, _ = materialize(narrow.groupBy(*LEVELS, "rest", F.substring("place", 1, DIGITS).alias("part")).agg(F.sum("n").alias("n")), "part-sums")
    ends = leaves.select(*LEVELS, F.lit("").alias("begins"), F.lit(0).cast(WHOLE).alias("before"))
    for digits in range(1, DIGITS + 1):  # one digit more of the part that holds the end, from sixteen sums a leaf
        near = parts.join(small(ends), [*LEVELS]).where(F.col("part").startswith(F.col("begins")))
        sums = near.groupBy(*LEVELS, "rest", "before", F.substring("part", 1, digits).alias("begins")).agg(F.sum("n").alias("n"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("n").over(by.orderBy("begins").rowsBetween(W.unboundedPreceding, W.currentRow)))
        ends = sums.where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("begins", (F.col("upto") - F.col("n")).cast(WHOLE).alias("before"))).alias("end")).select(*LEVELS, "end.begins", "end.before")
    ends, _ = materialize(ends.withColumnRenamed("begins", "part"), "ends")
    at = narrow.join(small(ends), [*LEVELS]).where(F.col("place").startswith(F.col("part")))
    keys = at.groupBy(*LEVELS, "part", "before", "rest", "place").agg(F.sum("n").alias("n"))
    keys = keys.withColumn("upto", F.col("before") + F.sum("n").over(by.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = keys.where("upto <= rest").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    cut = ends.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "part").alias("last"))
    plan = leaves.join(cut, list(LEVELS), "left").select(*[F.col(k).alias(f"__mix_plan_{k}") for k in LEVELS], F.col("full").alias("__mix_full"), F.coalesce("last", F.lit("g")).alias("__mix_last"))
    plan, _ = materialize(plan, "mixture")
    taken = rows.join(small(plan), [F.col(c) == F.col(f"__mix_plan_{k}") for c, k in zip(LEAF, LEVELS)])
    taken = taken.withColumn("__mix_times", F.col("__mix_full") + (place("__mix_full") <= F.col("__mix_last")).cast("int"))
    taken = taken.where("__mix_times > 0").withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0), F.col("__mix_times") - 1)))
    return taken.select(*docs.columns, *LEAF, "__mix_tokens", "__mix_epoch")


def select_rows(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The rows that the mixture takes, with the columns of docs alone."""
    return mix(docs, mixture).select(*docs.columns)


def oracle_sql(m: Mixture = Mixture()) -> str:
    """The same rows in DuckDB's SQL, without the shortcuts: every leaf is ordered whole."""
    case = lambda column, values, default: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {default!r} END" if values else repr(default)
    weight = {k: case(k, m.weights.get(k, {}), m.other) for k in LEVELS}
    out = f"""
WITH base AS (
  SELECT doc_id, {case("coalesce(source, '')", m.domains, m.default_domain)} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce((octet_length(encode(text)) + 3) // 4, 0) AS n FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n)::HUGEINT AS there,
         (CASE WHEN least({weight["domain"]}, {weight["lang"]}, {weight["source"]}) > 0 THEN sum(n) * {m.max_epochs} ELSE 0 END)::HUGEINT AS cap
  FROM base GROUP BY domain, lang, source
)"""
    above = f"least((SELECT sum(there) * {m.percent} // 100 FROM leaves), (SELECT sum(cap) FROM leaves))::HUGEINT"
    for i, level in enumerate(LEVELS):
        keys, parents = ", ".join(LEVELS[: i + 1]), ", ".join(LEVELS[:i])
        by = f"PARTITION BY {parents}" if parents else ""
        join = f"JOIN given{i - 1} USING ({parents})" if i else ""
        budget = f"given{i - 1}.budget" if i else above
        out += f""", sums{i} AS (
  SELECT {keys}, sum(cap)::HUGEINT AS cap, (CASE WHEN sum(cap) > 0 THEN {weight[level]} ELSE 0 END)::HUGEINT AS w FROM leaves GROUP BY {keys}
), node{i} AS (
  SELECT sums{i}.*, {budget} AS above FROM sums{i} {join}
), run{i} AS (
  SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind
  FROM node{i} WINDOW o AS ({by} ORDER BY cap::DOUBLE / nullif(w, 0)::DOUBLE ASC NULLS LAST, {keys})
), full{i} AS (
  SELECT *, w > 0 AND cap * behind <= (above - before) * w AS is_full FROM run{i}
), given{i} AS (
  SELECT {keys}, CASE WHEN is_full THEN cap WHEN open > 0 THEN (rest * w) // open ELSE 0 END AS budget FROM (
    SELECT *, above - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({by}), 0) AS rest, sum(w) FILTER (WHERE NOT is_full) OVER ({by}) AS open FROM full{i})
)"""
    return out + f""", planned AS (
  SELECT domain, lang, source, budget, CASE WHEN there > 0 THEN budget // there ELSE 0 END AS whole, there FROM leaves JOIN given2 USING (domain, lang, source)
), placed AS (
  SELECT base.*, whole, budget - whole * there AS rest, md5('{m.seed}:' || whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM base JOIN planned USING (domain, lang, source)
), taken AS (
  SELECT *, whole + (sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest)::INT AS times FROM placed
)
SELECT doc_id, domain, lang, source, n::BIGINT AS n_tokens, unnest(range(times::BIGINT))::INT AS epoch FROM taken
"""
