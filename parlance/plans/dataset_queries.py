"""Dataset rules over utterances that come as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import entities, ordering, rules
from parlance.plans import gen
from parlance.plans.registry import normal_sql, query
from parlance.session import table

DECLARED = "declared AS (SELECT 'product' AS entity, true AS extensible, true AS use_synonyms, 1.0::DOUBLE AS strictness UNION ALL SELECT 'brand', false, true, 0.5)"


def declared(spark):
    return spark.sql("SELECT 'product' AS entity, true AS extensible, true AS use_synonyms, 1.0D AS strictness UNION ALL SELECT 'brand', false, true, 0.5D")


@query(f"WITH {gen.SLOTS}, {DECLARED} SELECT * FROM declared UNION ALL SELECT DISTINCT entity, true, true, 1.0 FROM slots WHERE entity NOT IN (SELECT entity FROM declared)")
def add_missing_entities(spark, sf_dir):
    return rules.missing_entities(gen.slots(spark, sf_dir), declared(spark))


_builtin = ", ".join(f"'{k}'" for k in entities.BUILTIN_KINDS)


@query(
    f"""WITH {gen.SLOTS}, {DECLARED}, broken AS (SELECT id, n, CASE WHEN id % 11 = 0 THEN NULL ELSE raw_value END AS text, CASE WHEN id % 7 = 0 THEN NULL ELSE slot_name END AS slot_name, entity FROM slots)
SELECT id, n, 'no text' AS rule FROM broken WHERE text IS NULL UNION ALL SELECT id, n, 'slot and entity must come together' FROM broken WHERE (slot_name IS NULL) <> (entity IS NULL)
UNION ALL SELECT id, n, 'entity is not declared' FROM broken WHERE entity NOT IN (SELECT entity FROM declared) AND entity NOT IN ({_builtin})"""
)
def validation_violations(spark, sf_dir):
    """Breaches among the known slots after some of them have lost their text or their name."""
    broken = gen.slots(spark, sf_dir).select("id", "n", F.when(F.col("id") % 11 != 0, F.col("raw_value")).alias("text"), F.when(F.col("id") % 7 != 0, F.col("slot_name")).alias("slot_name"), "entity")
    return rules.violations(broken, declared(spark))


@query(
    """WITH v AS (SELECT p_name AS value, row_number() OVER (ORDER BY p_name) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT p_name FROM part)),
c AS (SELECT p_brand AS grp, p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS text FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY grp, text IS NULL ORDER BY ord) - 1 AS turn FROM c)
SELECT grp AS "group", ord, 'product' AS entity, coalesce(text, value) AS text FROM t LEFT JOIN v ON k = turn % m"""
)
def fill_implicit_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    v = p.select(F.col("p_name").alias("value")).distinct()
    values = ordering.numbered(v, F.left("value", F.lit(2)), ["value"], name="k").select(F.lit("product").alias("entity"), "value", "k", F.lit(v.count()).cast("long").alias("m"))
    chunks = p.select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("ord"), F.lit("product").alias("entity"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("text"))
    return rules.fill_implicit(chunks, values)


ANNOTATED = "annotated AS (SELECT p_partkey, 'need [product](' || p_name || ') by [maker:brand](' || p_brand || ') in [size:number]' AS text FROM part)"


@query(
    f"""WITH {ANNOTATED} SELECT p_partkey, unnest([0, 1, 2])::BIGINT AS n, unnest(['product', 'maker', 'size']) AS slot_name, unnest(['product', 'brand', 'number']) AS entity,
unnest([regexp_extract(text, '\\[product\\]\\(([^)]*)\\)', 1), regexp_extract(text, '\\[maker:brand\\]\\(([^)]*)\\)', 1), NULL]) AS value FROM annotated"""
)
def annotated_parse(spark, sf_dir):
    text = F.concat(F.lit("need [product]("), "p_name", F.lit(") by [maker:brand]("), "p_brand", F.lit(") in [size:number]"))
    out = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(rules.annotated_slots(text)).alias("n", "x"))
    return out.select("p_partkey", F.col("n").cast("long").alias("n"), "x.*")


@query(f"WITH {gen.DICTIONARY} SELECT kind, norm, resolved FROM entries")
def gazetteer_entries(spark, sf_dir):
    return gen.entries(spark, sf_dir).drop("n_tokens")


@query(
    f"""WITH {gen.DICTIONARY}, stemmed AS (SELECT kind, CASE WHEN length(norm) > 4 THEN left(norm, length(norm) - 2) ELSE norm END AS norm, min(resolved) AS resolved FROM entries GROUP BY 1, 2)
SELECT kind, norm, resolved FROM entries UNION ALL SELECT kind, norm, resolved FROM stemmed ANTI JOIN entries USING (kind, norm)"""
)
def gazetteer_stemmed_merge(spark, sf_dir):
    """Entries and their stemmed forms (here: without the last two letters); a stemmed form never replaces an entry."""
    raw = gen.entries(spark, sf_dir).select("kind", "norm", "resolved")
    stem = F.when(F.length("norm") > 4, F.expr("left(norm, length(norm) - 2)")).otherwise(F.col("norm"))
    stemmed = raw.groupBy("kind", stem.alias("norm")).agg(F.min("resolved").alias("resolved"))
    return raw.unionByName(stemmed.join(raw.select("kind", "norm"), ["kind", "norm"], "left_anti"))


@query(f"WITH {gen.DICTIONARY}, w AS (SELECT DISTINCT kind, unnest(string_split(norm, ' ')) AS word FROM entries) SELECT kind, count(*) AS n_words, floor(0.05 * count(*))::BIGINT AS n_stop_words FROM w GROUP BY kind")
def gazetteer_stop_budget(spark, sf_dir):
    words = gen.entries(spark, sf_dir).select("kind", F.explode(F.split("norm", " ")).alias("word")).distinct()
    return words.groupBy("kind").agg(F.count("*").alias("n_words")).withColumn("n_stop_words", F.floor(F.col("n_words") * 0.05))


@query(
    f"""WITH {gen.TOKS}, {gen.DICTIONARY}, low AS (SELECT id, {normal_sql('value')} AS word, count(*) AS there FROM toks GROUP BY 1, 2),
w AS (SELECT kind, norm, resolved, len(string_split(norm, ' ')) AS n, unnest(string_split(norm, ' ')) AS word FROM entries WHERE kind = 'product'), wanted AS (SELECT kind, norm, resolved, n, word, count(*) AS wanted FROM w GROUP BY ALL)
SELECT id, kind, resolved, sum(least(wanted, there)) / any_value(n) AS share FROM low JOIN wanted USING (word) GROUP BY id, kind, norm, resolved HAVING sum(least(wanted, there)) / any_value(n) >= 0.5"""
)
def gazetteer_partial(spark, sf_dir):
    products = gen.entries(spark, sf_dir).where("kind = 'product'")
    return entities.partial_matches(gen.utterances(spark, sf_dir), ["id"], products, 0.5)
