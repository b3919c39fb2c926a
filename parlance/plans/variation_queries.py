"""Surface variations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import variations
from parlance.plans.registry import query
from parlance.plans.text_queries import WORDS_SQL
from parlance.session import table

PUNCT = "[!-/:-@\\[-`{-~]"
#: Distinct values with up to three marks: every choice of dropping some.
PUNCT_SQL = f"""vals AS (SELECT DISTINCT o_orderpriority AS value FROM orders UNION SELECT DISTINCT p_brand FROM part), cut AS (
  SELECT value, unnest(regexp_extract_all(value, '{PUNCT}|[^!-/:-@\\[-`{{-~]+')) AS p, generate_subscripts(regexp_extract_all(value, '{PUNCT}|[^!-/:-@\\[-`{{-~]+'), 1) AS pos FROM vals
), marked AS (
  SELECT *, regexp_full_match(p, '{PUNCT}') AS m, count(*) FILTER (WHERE regexp_full_match(p, '{PUNCT}')) OVER (PARTITION BY value ORDER BY pos) - 1 AS b,
         count(*) FILTER (WHERE regexp_full_match(p, '{PUNCT}')) OVER (PARTITION BY value) AS n FROM cut
), masks AS (SELECT *, unnest(range(1 << n)) AS mask FROM marked WHERE n BETWEEN 1 AND 3)
SELECT DISTINCT value, variation FROM (SELECT value, mask, coalesce(string_agg(CASE WHEN m AND (mask >> b) % 2 = 1 THEN '' ELSE p END, '' ORDER BY pos), '') AS variation FROM masks GROUP BY value, mask)"""


@query("WITH " + PUNCT_SQL)
def punct_variations(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")).distinct().union(table(spark, sf_dir, "part").select("p_brand").distinct())
    return values.select("value", F.explode(variations.punctuation_variations(F.col("value"))).alias("variation")).distinct()


@query(
    """WITH vals AS (SELECT DISTINCT text FROM conversations WHERE contains(text, ' and ')), cut AS (
  SELECT text, string_split(replace(text, ' ', '  '), ' and ') AS a FROM vals
), masks AS (SELECT text, a, unnest(range(1 << (len(a) - 1))) AS mask FROM cut WHERE len(a) BETWEEN 2 AND 4)
SELECT DISTINCT text, replace(a[1] || list_reduce(list_prepend('', list_transform(range(1, len(a)), lambda k: (CASE WHEN (mask >> (k - 1)) % 2 = 1 THEN ' & ' ELSE ' and ' END) || a[k + 1])), lambda x, y: x || y), '  ', ' ') AS variation FROM masks"""
)
def and_variations(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select("text").distinct()
    return texts.select("text", F.explode(variations.and_variations(F.col("text"))).alias("variation")).distinct()


_numbers = f"SELECT n::VARCHAR AS n, {WORDS_SQL} AS words FROM range(100) r(n)"


@query(f"WITH w AS ({_numbers}) SELECT p_partkey, 'size ' || unnest([n, words]) || ' of ' || p_name AS variation FROM part JOIN w ON n = p_size::VARCHAR")
def number_variations(spark, sf_dir):
    value = F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" of "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(variations.number_variations(value)).alias("variation"))


def values(spark, sf_dir):
    """Brands with the products of each as synonyms; a product of several brands belongs to the first."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("synonyms"), F.min("p_partkey").alias("ord"))
    return p.select(F.lit("brand").alias("entity"), "ord", F.col("p_brand").alias("value"), "synonyms")


SYNONYMS = """brands AS (SELECT p_brand, min(p_partkey) AS ord FROM part GROUP BY p_brand), pairs AS (SELECT DISTINCT p_brand, p_name FROM part),
surfaces AS (
  SELECT p_brand AS surface, p_brand AS resolved FROM brands
  UNION ALL SELECT p_name, arg_min(p_brand, struct_pack(o := ord, b := p_brand)) FROM pairs JOIN brands USING (p_brand) WHERE p_name NOT IN (SELECT p_brand FROM brands) GROUP BY p_name
)"""


@query(f"WITH {SYNONYMS} SELECT 'brand' AS entity, surface, resolved FROM surfaces")
def synonym_resolution(spark, sf_dir):
    return variations.synonym_surfaces(values(spark, sf_dir))


#: Lower case and title case of the surfaces, with their # kept or dropped; further rules change none of these values.
@query(
    f"""WITH {SYNONYMS}, titled AS (
  SELECT surface, resolved, list_reduce(list_prepend('', list_transform(regexp_extract_all(surface, '[a-zA-Z]+|[^a-zA-Z]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2)))), lambda a, b: a || b) AS titled FROM surfaces
), cased AS (SELECT resolved, unnest([surface, lower(surface), titled]) AS v FROM titled
), dropped AS (SELECT resolved, unnest([v, replace(v, '#', '')]) AS v FROM cased
), n AS ({_numbers}
), numbered AS (SELECT resolved, v FROM dropped UNION ALL SELECT resolved, replace(v, n, words) FROM dropped JOIN n ON n.n = regexp_extract(v, '[0-9]+')
), made AS (SELECT DISTINCT resolved, unnest([trim(v), trim(regexp_replace(regexp_replace(v, '[^a-zA-Z0-9]+', ' ', 'g'), ' +', ' ', 'g'))]) AS v FROM numbered
), alone AS (SELECT v, min(resolved) AS resolved FROM made GROUP BY v HAVING count(*) = 1 AND v <> '' AND v NOT IN (SELECT surface FROM surfaces))
SELECT 'brand' AS entity, surface, resolved FROM surfaces UNION ALL SELECT 'brand', v, resolved FROM alone"""
)
def surface_expansion(spark, sf_dir):
    return variations.expand_surfaces(variations.synonym_surfaces(values(spark, sf_dir)))
