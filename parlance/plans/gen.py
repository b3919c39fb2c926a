"""Utterances with known intents and slots, made of the relational tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import entities
from parlance.plans.registry import normal_sql, tokens_sql
from parlance.session import table

#: intent: (table, id, parts); a part is a literal or (slot, entity, SQL expression that both engines read alike).
TEMPLATES = {
    "orderLookup": ("orders", "o_orderkey", ["find order ", ("order", "number", "cast(o_orderkey AS STRING)"), " worth ", ("worth", "amountOfMoney", "concat('$', cast(cast(o_totalprice AS DECIMAL(18,2)) AS STRING))"), " with priority ", ("priority", "priority", "o_orderpriority")]),
    "partSearch": ("part", "1000000000 + p_partkey", ["i need ", ("quantity", "number", "cast(p_size AS STRING)"), " ", ("product", "product", "p_name"), " from ", ("brand", "brand", "p_brand"), " at ", ("discount", "percentage", "concat(cast(p_partkey % 100 AS STRING), '%')")]),
    "reminder": ("customer", "2000000000 + c_custkey", ["remind me of the ", ("visit", "ordinal", "concat(cast(c_custkey % 16 + 4 AS STRING), 'th')"), " visit on ", ("day", "date", "concat('20', cast(c_custkey % 80 + 10 AS STRING), '-', cast(c_custkey % 3 + 10 AS STRING), '-', cast(c_custkey % 18 + 10 AS STRING))"), " for ", ("stay", "duration", "concat(cast(c_custkey % 9 + 2 AS STRING), ' days')"), " at ", ("warmth", "temperature", "concat(cast(c_custkey % 40 AS STRING), ' degrees celsius')")]),
}


def _text(parts: list) -> str:
    return "concat(" + ", ".join(f"'{p}'" if isinstance(p, str) else p[2] for p in parts) + ")"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, intent, text."""
    out = None
    for intent, (name, key, parts) in TEMPLATES.items():
        own = table(spark, sf_dir, name).select(F.expr(f"cast({key} AS BIGINT)").alias("id"), F.lit(intent).alias("intent"), F.expr(_text(parts)).alias("text"))
        out = own if out is None else out.unionByName(own)
    return out


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, intent, n (from 0), slot_name, entity, s, e, raw_value: the truth for those utterances."""
    out = None
    for intent, (name, key, parts) in TEMPLATES.items():
        items, at = [], F.lit(0)
        for p in parts:
            if isinstance(p, str):
                at = at + len(p)
            else:
                value = F.expr(p[2])
                items.append(F.struct(F.lit(len(items)).cast("long").alias("n"), F.lit(p[0]).alias("slot_name"), F.lit(p[1]).alias("entity"), at.cast("long").alias("s"), (at + F.length(value)).cast("long").alias("e"), value.alias("raw_value")))
                at = at + F.length(value)
        own = table(spark, sf_dir, name).select(F.expr(f"cast({key} AS BIGINT)").alias("id"), F.lit(intent).alias("intent"), F.explode(F.array(*items)).alias("x")).select("id", "intent", "x.*")
        out = own if out is None else out.unionByName(own)
    return out


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, surface, resolved: products (resolved to upper case), brands and priorities."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    out = part.select(F.lit("product").alias("kind"), F.col("p_name").alias("surface"), F.upper("p_name").alias("resolved"))
    out = out.unionByName(part.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("surface"), F.col("p_brand").alias("resolved")))
    return out.unionByName(orders.select(F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("surface"), F.col("o_orderpriority").alias("resolved"))).distinct()


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.gazetteer(dictionary(spark, sf_dir))


#: Builtin kinds that are looked for in the utterances.
KINDS = ("amountOfMoney", "duration", "number", "ordinal", "temperature", "date", "percentage")


def found(texts: DataFrame, known: DataFrame) -> DataFrame:
    """id, kind, s, e, value, resolved of builtin and dictionary matches in texts (id, text)."""
    builtin = entities.builtin_matches(texts, ["id"], KINDS).select("id", "kind", "s", "e", "value", F.col("value").alias("resolved"))
    return builtin.unionByName(entities.gazetteer_matches(texts, ["id"], known))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches in all generated utterances."""
    return found(utterances(spark, sf_dir), entries(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.keep_longest(matches(spark, sf_dir), ["id"])


def rewritten(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return entities.replace_with_placeholders(utterances(spark, sf_dir), kept(spark, sf_dir), ["id"])


def _sql_value(expression: str) -> str:
    return expression.replace("STRING", "VARCHAR")


GEN = "gen AS (" + " UNION ALL ".join(f"SELECT ({key})::BIGINT AS id, '{intent}' AS intent, {_sql_value(_text(parts))} AS text FROM {name}" for intent, (name, key, parts) in TEMPLATES.items()) + ")"


def _slot_sql() -> str:
    rows = []
    for intent, (name, key, parts) in TEMPLATES.items():
        n, at = 0, "0"
        for p in parts:
            if isinstance(p, str):
                at += f" + {len(p)}"
            else:
                v = _sql_value(p[2])
                rows.append(f"SELECT ({key})::BIGINT AS id, '{intent}' AS intent, {n}::BIGINT AS n, '{p[0]}' AS slot_name, '{p[1]}' AS entity, ({at})::BIGINT AS s, ({at} + length({v}))::BIGINT AS e, {v} AS raw_value FROM {name}")
                n, at = n + 1, f"{at} + length({v})"
    return "slots AS (" + " UNION ALL ".join(rows) + ")"


SLOTS = _slot_sql()
TOKS = GEN + ", " + tokens_sql("gen", "id")
#: Every kind read from the text itself by a regular expression, where the twin reads tokens.
_RX = {
    "percentage": "[0-9]+(?:\\.[0-9]+)?%", "amountOfMoney": "\\$[0-9]+(?:\\.[0-9]+)?", "ordinal": "\\b[0-9]+(?:st|nd|rd|th)\\b",
    "temperature": "\\b[0-9]+ degrees celsius\\b", "duration": "\\b[0-9]+ days\\b", "date": "\\b[0-9]{4}-[0-9]{2}-[0-9]{2}\\b",
}
_found = " UNION ALL ".join(f"SELECT id, text, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{rx}'))) AS value FROM gen" for k, rx in _RX.items())
BUILTIN = f"""{TOKS}, rx AS ({_found}), builtin AS (
  SELECT id, kind, (position(value IN text) - 1)::BIGINT AS s, (position(value IN text) - 1 + length(value))::BIGINT AS e, value, CASE WHEN kind <> 'date' THEN regexp_extract(value, '[0-9]+(?:\\.[0-9]+)?')::DOUBLE END AS number,
         CASE kind WHEN 'amountOfMoney' THEN '$' WHEN 'temperature' THEN 'celsius' WHEN 'duration' THEN 'day' END AS unit FROM rx
  UNION ALL
  SELECT id, 'number', s, num_e, substr(text, (s + 1)::INT, (num_e - s)::INT), substr(text, (s + 1)::INT, (num_e - s)::INT)::DOUBLE, NULL FROM (
    SELECT id, text, s, value, CASE WHEN regexp_matches(lead(value) OVER w, '^[0-9]+$') AND lead(s) OVER w = e + 1 AND substr(text, (e + 1)::INT, 1) = '.' THEN lead(e) OVER w ELSE e END AS num_e,
           coalesce(regexp_matches(lag(value) OVER w, '^[0-9]+$') AND lag(e) OVER w + 1 = s AND substr(text, s::INT, 1) = '.', false) AS inside
    FROM toks JOIN gen USING (id) WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE regexp_matches(value, '^[0-9]+$') AND NOT inside
)"""
DICTIONARY = f"""dict AS (SELECT DISTINCT * FROM (SELECT 'product' AS kind, p_name AS surface, upper(p_name) AS resolved FROM part UNION ALL SELECT 'brand', p_brand, p_brand FROM part UNION ALL SELECT 'priority', o_orderpriority, o_orderpriority FROM orders)),
entries AS (SELECT kind, array_to_string(regexp_extract_all({normal_sql('surface')}, '[\\p{{L}}\\p{{N}}_]+|[$%!?&]'), ' ') AS norm, min(resolved) AS resolved FROM dict GROUP BY 1, 2)"""
MATCHES = f"""{BUILTIN}, {DICTIONARY}, spread AS (
  SELECT id, list(v ORDER BY i) AS vs, list(s ORDER BY i) AS ss, list(e ORDER BY i) AS es FROM (SELECT *, {normal_sql('value')} AS v FROM toks) GROUP BY id
), sizes AS (SELECT DISTINCT len(string_split(norm, ' ')) AS k FROM entries
), grams AS (
  SELECT id, ss[a] AS s, es[a + k - 1] AS e, array_to_string(vs[a : a + k - 1], ' ') AS norm FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS a FROM spread), sizes WHERE a + k - 1 <= len(vs)
), gaz AS (SELECT id, kind, s, e, substr(text, (s + 1)::INT, (e - s)::INT) AS value, resolved FROM grams JOIN entries USING (norm) JOIN gen USING (id)
), matches AS MATERIALIZED (SELECT id, kind, s, e, value, value AS resolved FROM builtin UNION ALL SELECT id, kind, s, e, value, resolved FROM gaz)"""
KEPT = f"""{MATCHES}, folded AS (
  SELECT id, list_reduce(list([m] ORDER BY m.o, m.c, m.s, m.kind), lambda a, b: CASE WHEN len(list_filter(a, lambda y: y.s < b[1].e AND b[1].s < y.e)) > 0 THEN a ELSE list_concat(a, b) END) AS ms
  FROM (SELECT id, struct_pack(o := s - e, c := kind IN ('product', 'brand', 'priority'), s := s, e := e, kind := kind, value := value, resolved := resolved) AS m FROM matches) GROUP BY id
), kept AS (SELECT id, m.kind AS kind, m.s AS s, m.e AS e, m.value AS value, m.resolved AS resolved FROM (SELECT id, unnest(ms) AS m FROM folded))"""
REWRITTEN = f"""{KEPT}, marked AS (SELECT *, '%' || upper(kind) || '%' AS mark FROM kept), ranged AS (
  SELECT *, (s + shift)::BIGINT AS new_s, (s + shift + length(mark))::BIGINT AS new_e FROM (
    SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(e) OVER w, 0) AS f, coalesce(sum(length(mark) - (e - s)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM marked WINDOW w AS (PARTITION BY id ORDER BY s))
), rewritten AS (
  SELECT id, coalesce(string_agg(substr(text, (f + 1)::INT, (s - f)::INT) || mark, '' ORDER BY s), '') || substr(any_value(text), (coalesce(max(e), 0) + 1)::INT) AS rewritten FROM gen LEFT JOIN ranged USING (id) GROUP BY id)"""
