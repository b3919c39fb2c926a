"""The engine over the generated utterances: fitted on a small annotated dataset of the same requests, held against what the utterances were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.plans import gen
from parlance.plans.config import EngineConfig, LookupConfig, PatternConfig
from parlance.plans.engine import IntentEngine, IntentEngineModel
from parlance.plans.registry import query
from parlance.session import table
from parlance.sources.dataset import Dataset, Entity, parse_annotation

UTTERANCES = {
    "orderLookup": ["find order [order:number](17) worth [worth:amountOfMoney]($99.50) with priority [priority:priority](1-URGENT)"],
    "partSearch": ["i need [quantity:number](3) [product:product]({product}) from [brand:brand](Brand#11) at [discount:percentage](5%)"],
    "reminder": ["remind me of the [visit:ordinal](4th) visit on [day:date](2031-05-17) for [stay:duration](3 days) at [warmth:temperature](20 degrees celsius)"],
}


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """One utterance of each intent, and the distinct brands, priorities and product names of the tables as dictionaries (a catalogue's, not as many as its rows)."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    of = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect() if r[0])
    names = of(part, "p_name")
    entities = {
        "product": Entity("product", values=[(n.upper(), [n]) for n in names]),
        "brand": Entity("brand", extensible=False, values=[(b, []) for b in of(part, "p_brand")]),
        "priority": Entity("priority", extensible=False, values=[(p, []) for p in of(orders, "o_orderpriority")]),
    }
    intents = {i: [parse_annotation(u.replace("{product}", names[0] if names else "x")) for u in said] for i, said in UTTERANCES.items()}
    return Dataset("en", intents, entities)._completed({})


def fitted(spark: SparkSession, sf_dir: str, *parsers) -> IntentEngineModel:
    return IntentEngine(spark, EngineConfig(parsers or (LookupConfig(), PatternConfig()))).fit(dataset(spark, sf_dir))


def slot_rows(parsed: DataFrame, *columns: str) -> DataFrame:
    each = parsed.select(*columns, F.explode("slots").alias("x"))
    return each.select(*columns, "x.slot_name", "x.entity", F.col("x.start").alias("s"), F.col("x.end").alias("e"), "x.raw_value", "x.resolved")


RESOLVED = "CASE WHEN entity = 'product' THEN upper(raw_value) ELSE raw_value END AS resolved"


@query(f"WITH {gen.SLOTS} SELECT id, intent, 1.0::DOUBLE AS probability, slot_name, entity, s, e, raw_value, {RESOLVED} FROM slots")
def engine_parse(spark, sf_dir):
    """Lookup, then patterns; every utterance's intent and resolved slots."""
    return slot_rows(fitted(spark, sf_dir).parse(gen.utterances(spark, sf_dir)), "id", "intent", "probability")


@query(f"WITH {gen.SLOTS} SELECT id, intent, slot_name, entity, s, e, raw_value, {RESOLVED} FROM slots WHERE intent <> 'reminder'")
def engine_parse_scoped(spark, sf_dir):
    """Patterns alone, and of two intents only."""
    parsed = fitted(spark, sf_dir, PatternConfig()).parse(gen.utterances(spark, sf_dir), ["orderLookup", "partSearch"])
    return slot_rows(parsed, "id", "intent")


@query(f"WITH {gen.GEN}, intents AS (SELECT DISTINCT intent FROM gen) SELECT g.id, i.intent, CASE WHEN g.intent = i.intent THEN 1.0 ELSE 0.0 END::DOUBLE AS probability FROM gen g CROSS JOIN intents i")
def engine_intents(spark, sf_dir):
    return fitted(spark, sf_dir).get_intents(gen.utterances(spark, sf_dir))


@query(f"WITH {gen.SLOTS} SELECT id, slot_name, entity, s, e, raw_value, {RESOLVED} FROM slots WHERE intent = 'partSearch'")
def engine_slots(spark, sf_dir):
    return slot_rows(fitted(spark, sf_dir).get_slots(gen.utterances(spark, sf_dir), "partSearch"), "id")


@query(f"WITH {gen.GEN}, {gen.SLOTS}, c AS (SELECT id, count(*) AS n_slots FROM slots GROUP BY id) SELECT id, 1::BIGINT AS rank, intent, 1.0::DOUBLE AS probability, n_slots FROM gen JOIN c USING (id)")
def engine_top(spark, sf_dir):
    """The two best intents of each utterance; only one has any candidate."""
    top = fitted(spark, sf_dir).parse_top(gen.utterances(spark, sf_dir), 2)
    return top.select("id", F.col("rank").cast("long").alias("rank"), "intent", "probability", F.size("slots").cast("long").alias("n_slots"))


MANY = f"""many AS (SELECT 1000000000 + p_partkey AS id, p_size::VARCHAR AS size, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE regexp_replace(p_name, '([a-zA-Z]+)', '\\1s', 'g') END AS said, upper(p_name) AS resolved,
  p_brand AS brand, (p_partkey % 100)::VARCHAR || '%' AS off FROM part),
placed AS (SELECT *, 8 + length(size) AS at_said, 14 + length(size) + length(said) AS at_brand, 18 + length(size) + length(said) + length(brand) AS at_off FROM many)"""


def _slot(name: str, entity: str, at: str, value: str, resolved: str) -> str:
    return f"SELECT id::BIGINT AS id, '{name}' AS slot_name, '{entity}' AS entity, ({at})::BIGINT AS s, ({at} + length({value}))::BIGINT AS e, {value} AS raw_value, {resolved} AS resolved FROM placed"


@query(
    f"""WITH {MANY} {_slot('quantity', 'number', '7', 'size', 'size')} UNION ALL {_slot('product', 'product', 'at_said', 'said', 'resolved')}
UNION ALL {_slot('brand', 'brand', 'at_brand', 'brand', 'brand')} UNION ALL {_slot('discount', 'percentage', 'at_off', 'off', 'off')}"""
)
def engine_stemmed(spark, sf_dir):
    """Requests for every part, half of them with the words of its name in the plural, which the dictionary does not have: these match by their stems, the others by their own forms."""
    part = table(spark, sf_dir, "part")
    forms = part.select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("stem")).distinct().select(F.concat("stem", F.lit("s")).alias("form"), "stem")
    engine = IntentEngine(spark, EngineConfig((LookupConfig(), PatternConfig()), entity_matching="both"), {"stems": {"stems": forms}})
    said = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", "([a-zA-Z]+)", "$1s"))
    text = F.concat(F.lit("i need "), F.col("p_size").cast("string"), F.lit(" "), said, F.lit(" from "), "p_brand", F.lit(" at "), (F.col("p_partkey") % 100).cast("string"), F.lit("%"))
    asked = part.select((F.lit(1000000000) + F.col("p_partkey")).cast("long").alias("id"), text.alias("text"))
    return slot_rows(engine.fit(dataset(spark, sf_dir)).parse(asked), "id")
