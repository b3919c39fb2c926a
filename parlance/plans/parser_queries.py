"""Parsers over the generated utterances: fitted on their known slots, run on what the extractors find."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import entities, joins, parsers
from parlance.plans import gen
from parlance.plans.registry import query
from parlance.session import table
from parlance.storage import materialize

TOKEN_RX = "[\\p{L}\\p{N}_]+|[$%!?&]"
GAP_SQL = "[^\\p{L}\\p{N}_$%!?&]*"


def _key(column: str) -> str:
    return f"lower(array_to_string(regexp_extract_all({column}, '{TOKEN_RX}'), ' '))"


TRAINED = f"""{gen.GEN}, {gen.SLOTS}, smarked AS (SELECT *, '%' || upper(entity) || '%' AS mark, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS f FROM slots), trained AS (
  SELECT id, any_value(gen.intent) AS intent, coalesce(string_agg(substr(text, (f + 1)::INT, (s - f)::INT) || mark, '' ORDER BY s), '') || substr(any_value(text), (coalesce(max(e), 0) + 1)::INT) AS trained,
         string_agg(slot_name, ',' ORDER BY n) AS slot_names, count(slot_name) AS n_slots FROM gen LEFT JOIN smarked USING (id) GROUP BY id)"""
LOOKUP = f"""{TRAINED}, lookup AS (SELECT {_key('trained')} AS key, min(intent) AS intent, min(slot_names) AS slot_names, min(n_slots) AS n_slots FROM trained GROUP BY 1 HAVING count(DISTINCT intent || ':' || slot_names) = 1)"""
#: The parts of both, in one WITH.
PARSED = gen.REWRITTEN + ", " + LOOKUP.removeprefix(gen.GEN + ", ")
HITS = f"""{PARSED}, found AS (SELECT id, count(*) AS n FROM ranged GROUP BY id), hits AS (
  SELECT r.id, l.intent, l.slot_names, l.n_slots FROM rewritten r LEFT JOIN found USING (id) JOIN lookup l ON l.key = {_key('r.rewritten')} AND l.n_slots = coalesce(found.n, 0))"""
SLOTTED = f"""{HITS}, slotted AS (SELECT h.id, h.intent, r.n, string_split(h.slot_names, ',')[r.n + 1] AS slot_name, r.kind, r.s, r.e, r.value FROM hits h JOIN ranged r USING (id))"""


def trained(spark, sf_dir):
    texts, slots = gen.utterances(spark, sf_dir), gen.slots(spark, sf_dir)
    return joins.by_key(parsers.training_keys(texts, slots), texts.select("id", "intent"), "id")


def lookup(spark, sf_dir):
    return parsers.build_lookup(trained(spark, sf_dir), gen.slots(spark, sf_dir))


def patterns(spark, sf_dir):
    return parsers.build_patterns(trained(spark, sf_dir), gen.slots(spark, sf_dir))


def lookup_hits(spark, sf_dir):
    return parsers.lookup_parse(gen.utterances(spark, sf_dir), gen.kept(spark, sf_dir), materialize(lookup(spark, sf_dir), "lookup")[0], ["id"])


def parsed(spark, sf_dir):
    return parsers.slot_rows(lookup_hits(spark, sf_dir), ["id"])


@query(f"WITH {LOOKUP} SELECT key, intent, slot_names, n_slots FROM lookup")
def lookup_build(spark, sf_dir):
    return lookup(spark, sf_dir).select("key", "intent", F.array_join("slot_names", ",").alias("slot_names"), "n_slots")


@query(f"WITH {SLOTTED} SELECT id, intent, n, slot_name, kind, s, e, value FROM slotted")
def lookup_parse(spark, sf_dir):
    return parsed(spark, sf_dir)


@query(
    f"""WITH {PARSED}, num AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM ranged), masks AS (
  SELECT id, text, unnest(range(1 << coalesce((SELECT any_value(c) FROM num WHERE num.id = gen.id), 0))) AS mask FROM gen
), chosen AS (SELECT m.id, m.mask, n.s, n.e, n.mark, coalesce(lag(n.e) OVER (PARTITION BY m.id, m.mask ORDER BY n.s), 0) AS f FROM masks m JOIN num n ON m.id = n.id AND (m.mask >> n.n) % 2 = 1
), tried AS (
  SELECT m.id, m.mask, coalesce(string_agg(substr(text, (f + 1)::INT, (s - f)::INT) || mark, '' ORDER BY s), '') || substr(any_value(text), (coalesce(max(e), 0) + 1)::INT) AS rewritten, count(mark) AS found
  FROM masks m LEFT JOIN chosen c USING (id, mask) GROUP BY m.id, m.mask
), cand AS (SELECT id, mask, intent, n_slots FROM tried JOIN lookup ON key = {_key('rewritten')} AND n_slots = found)
SELECT id, mask, intent, n_slots FROM cand QUALIFY row_number() OVER (PARTITION BY id, intent ORDER BY n_slots, mask) = 1"""
)
def lookup_powerset(spark, sf_dir):
    """Any subset of the entities found may be read as placeholders; of an intent's hits the one with fewest slots stays."""
    return lookup_hits(spark, sf_dir).select("id", parsers.mask(F.col("found")).cast("long").alias("mask"), "intent", "n_slots")


_ESC = r"regexp_replace(lower(t), '([\\.+*?()|\[\]{}^$#&\-~])', '\\\1', 'g')"
PATTERNS = f"""{PARSED}, cut AS (SELECT id, intent, regexp_extract_all(trained, '%[A-Z]+%|{TOKEN_RX}') AS ts FROM trained), shaped AS (
  SELECT id, intent, '^{GAP_SQL}' || array_to_string(list_transform(ts, lambda t: CASE WHEN regexp_full_match(t, '%[A-Z]+%') THEN '(' || t || ')' ELSE {_ESC} END), '{GAP_SQL}') || '{GAP_SQL}$' AS pattern FROM cut
), single AS (SELECT pattern, min(intent) AS intent, min(id) AS id FROM shaped GROUP BY pattern HAVING count(DISTINCT intent) = 1 AND length(pattern) < 1000
), patterns AS (SELECT intent, row_number() OVER (PARTITION BY intent ORDER BY id, pattern) - 1 AS ord, pattern FROM single QUALIFY ord < 100)"""
PATTERN_HITS = f"""{PATTERNS}, dhits AS MATERIALIZED (
  SELECT r.rewritten, p.intent, p.ord, len(regexp_extract_all(p.pattern, '\\(%[A-Z]+%\\)'))::BIGINT AS n_slots FROM (SELECT DISTINCT rewritten FROM rewritten) r JOIN patterns p ON regexp_matches(r.rewritten, p.pattern)
  QUALIFY row_number() OVER (PARTITION BY r.rewritten, p.intent ORDER BY p.ord) = 1
), phits AS (SELECT id, intent, ord, n_slots FROM rewritten JOIN dhits USING (rewritten))"""


@query(f"WITH {PATTERNS} SELECT intent, ord, pattern FROM patterns")
def pattern_build(spark, sf_dir):
    return patterns(spark, sf_dir).select("intent", "ord", "pattern")


def pattern_hits(spark, sf_dir):
    return parsers.pattern_parse(gen.utterances(spark, sf_dir), gen.kept(spark, sf_dir), materialize(patterns(spark, sf_dir), "patterns")[0], ["id"])


def both_hits(spark, sf_dir):
    """The hits of the lookup and of the pattern parser; entities and training keys, which both read, are found once. Of an utterance and intent either has one hit at most."""
    kept, _ = materialize(gen.kept(spark, sf_dir), "kept")
    keyed, _ = materialize(trained(spark, sf_dir), "trained")
    texts, slots = gen.utterances(spark, sf_dir), gen.slots(spark, sf_dir)
    one = parsers.lookup_parse(texts, kept, materialize(parsers.build_lookup(keyed, slots), "lookup")[0], ["id"])
    return one, parsers.pattern_parse(texts, kept, materialize(parsers.build_patterns(keyed, slots), "patterns")[0], ["id"])


@query(f"WITH {PATTERN_HITS} SELECT id, intent, ord, n_slots FROM phits")
def pattern_parse(spark, sf_dir):
    return pattern_hits(spark, sf_dir).select("id", "intent", "ord", "n_slots")


@query(f"""WITH {PATTERN_HITS}, named AS (SELECT intent, n, any_value(slot_name) AS slot_name FROM slots GROUP BY intent, n)
SELECT p.id, p.intent, r.n, slot_name, r.kind, r.s, r.e, r.value FROM phits p JOIN ranged r USING (id) JOIN named USING (intent, n)""")
def pattern_slots(spark, sf_dir):
    """The slots of the pattern that fits: its placeholders' entities in the text."""
    return parsers.slot_rows(pattern_hits(spark, sf_dir), ["id"])


CANDIDATES = f"{gen.KEPT}, cand AS (SELECT id, kind AS intent, count(*) AS n_slots FROM kept GROUP BY id, kind)"


@query(
    f"""WITH {CANDIDATES}, p AS (SELECT id, intent, (1 / (1 + n_slots)) / sum(1 / (1 + n_slots)) OVER (PARTITION BY id) AS p FROM cand)
SELECT id, intent, round(p, 6) AS probability FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(p, 6) DESC, intent) <= 2"""
)
def reweight_topn(spark, sf_dir):
    candidates = gen.kept(spark, sf_dir).groupBy("id", F.col("kind").alias("intent")).agg(F.count("*").alias("n_slots"))
    return parsers.reweight(candidates, 2).select("id", "intent", F.round("probability", 6).alias("probability"))


CASCADE = PATTERN_HITS + ", " + HITS.removeprefix(PARSED + ", ")


@query(
    f"""WITH {CASCADE}, one AS (SELECT DISTINCT id, intent, 1.0::DOUBLE AS probability, 0::BIGINT AS stage FROM hits WHERE intent <> 'reminder'),
two AS (SELECT id, intent, 1.0::DOUBLE AS probability, 1::BIGINT AS stage FROM phits WHERE id NOT IN (SELECT id FROM one))
SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT id, NULL, 1.0, NULL FROM gen WHERE id NOT IN (SELECT id FROM one) AND id NOT IN (SELECT id FROM two)"""
)
def cascade_parse(spark, sf_dir):
    """The lookup parser, which is not asked for reminders here, then the pattern parser, then no intent."""
    one, two = (hits.select("id", "intent", F.lit(1.0).alias("probability")) for hits in both_hits(spark, sf_dir))
    return parsers.cascade(gen.utterances(spark, sf_dir), one.where("intent <> 'reminder'"), two)


@query(
    f"""WITH {CASCADE}, scores AS (SELECT id, intent, 0.75 AS p FROM hits UNION ALL SELECT id, intent, round(1 / (1 + n_slots), 6) FROM phits),
best AS (SELECT id, intent, max(p) AS p FROM scores GROUP BY id, intent), intents AS (SELECT DISTINCT intent FROM gen)
SELECT g.id, i.intent, coalesce(p, 0)::DOUBLE AS probability FROM gen g CROSS JOIN intents i LEFT JOIN best b ON b.id = g.id AND b.intent = i.intent"""
)
def get_intents_union_max(spark, sf_dir):
    one, two = both_hits(spark, sf_dir)
    one = one.select("id", "intent", F.lit(0.75).alias("probability"))
    two = two.select("id", "intent", F.round(1 / (1 + F.col("n_slots")), 6).alias("probability"))
    texts = gen.utterances(spark, sf_dir)
    return parsers.merge_scores(texts, texts.select("intent").distinct(), one, two)


@query(
    f"""WITH {gen.MATCHES}, {gen.SLOTS}, ex AS (SELECT id, kind, s, e, min(resolved) AS exact FROM matches GROUP BY ALL)
SELECT id, slot_name, s.entity, s.s, s.e, raw_value, resolved FROM (
  SELECT s.*, coalesce(exact, en.resolved, CASE WHEN s.entity = 'product' THEN raw_value END) AS resolved FROM slots s
  LEFT JOIN ex ON ex.id = s.id AND ex.kind = s.entity AND ex.s = s.s AND ex.e = s.e
  LEFT JOIN entries en ON en.kind = s.entity AND en.norm = array_to_string(regexp_extract_all({gen.normal_sql('raw_value')}, '{TOKEN_RX}'), ' ')) s WHERE resolved IS NOT NULL"""
)
def slot_resolution(spark, sf_dir):
    extensible = spark.sql("SELECT 'product' AS entity, true AS yes")
    return parsers.resolve_slots(gen.slots(spark, sf_dir).drop("intent", "n"), gen.matches(spark, sf_dir), gen.entries(spark, sf_dir), extensible)


@query(f"WITH {gen.SLOTS}, own AS (SELECT intent, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities FROM slots GROUP BY intent) SELECT entities, string_agg(intent, ',' ORDER BY intent) AS intents FROM own GROUP BY entities")
def entity_scopes(spark, sf_dir):
    return parsers.entity_scopes(gen.slots(spark, sf_dir).select("intent", "entity"))


@query(f"WITH {gen.SLOTS} SELECT DISTINCT intent, entity FROM slots")
def intent_entities(spark, sf_dir):
    return gen.slots(spark, sf_dir).select("intent", "entity").distinct()


@query(f"WITH {gen.SLOTS} SELECT intent, slot_name, arg_min(entity, struct_pack(id := id, n := n)) AS first_entity, arg_max(entity, struct_pack(id := id, n := n)) AS last_entity FROM slots GROUP BY intent, slot_name")
def slot_mapping(spark, sf_dir):
    order = F.struct("id", "n")
    return gen.slots(spark, sf_dir).groupBy("intent", "slot_name").agg(F.min_by("entity", order).alias("first_entity"), F.max_by("entity", order).alias("last_entity"))


@query(
    f"""WITH {SLOTTED}, listed AS (SELECT id, intent, list(struct_pack(range := struct_pack(start := s, "end" := e), rawValue := value, entity := kind, slotName := slot_name) ORDER BY n) AS slots FROM slotted GROUP BY id, intent)
SELECT id, to_json(struct_pack(intent := struct_pack(intentName := intent, probability := 1.0::DOUBLE), slots := slots))::VARCHAR AS result FROM listed"""
)
def json_result(spark, sf_dir):
    return parsers.parsing_result(parsed(spark, sf_dir))
