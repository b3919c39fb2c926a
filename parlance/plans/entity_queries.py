"""Entity extraction over the generated utterances."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import spoken
from parlance.functions.text import each
from parlance.operators import calendar, entities, grammar, joins
from parlance.plans import gen
from parlance.plans.registry import query
from parlance.session import table


@query(f"WITH {gen.GEN} SELECT id, intent, text FROM gen")
def gen_utterances(spark, sf_dir):
    return gen.utterances(spark, sf_dir)


@query(f"WITH {gen.SLOTS} SELECT id, intent, n, slot_name, entity, s, e, raw_value FROM slots")
def gen_slots(spark, sf_dir):
    return gen.slots(spark, sf_dir)


def _builtin(kind: str):
    def run(spark, sf_dir):
        return entities.builtin_matches(gen.utterances(spark, sf_dir), ["id"], (kind,))

    run.__name__ = f"builtin_{'money' if kind == 'amountOfMoney' else kind}"
    return query(f"WITH {gen.BUILTIN} SELECT id, kind, s, e, value, number, unit FROM builtin WHERE kind = '{kind}'")(run)


for _kind in ("number", "percentage", "amountOfMoney", "ordinal", "temperature", "duration", "date"):
    _builtin(_kind)


_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_DAYS, _MONTHS = grammar.LANGUAGES["en"].weekdays, grammar.LANGUAGES["en"].months
#: Requests with a weekday, an hour, a day of a month and two periods.
CALENDAR = f"""cal AS (SELECT c_custkey AS id, {_list(_DAYS)}[c_custkey % 7 + 1] AS wd, (c_custkey % 12 + 1)::VARCHAR || CASE WHEN c_custkey % 2 = 0 THEN ' am' ELSE ' pm' END AS hour,
  {_list(_MONTHS)}[c_custkey % 12 + 1] || ' ' || (c_custkey % 28 + 1)::VARCHAR AS day, ['this', 'next', 'last'][c_custkey % 3 + 1] || ' ' || ['week', 'month', 'year'][c_custkey % 3 + 1] AS period, ['morning', 'afternoon', 'evening', 'night'][c_custkey % 4 + 1] AS part FROM customer
), said AS (SELECT *, 'Visit next ' || wd || ' at ' || hour || ' or ' || day || ', ' || period || ' in the ' || part || '.' AS text FROM cal
), marks AS (SELECT id, text, unnest(['date', 'date', 'time', 'datetime', 'datetime', 'datePeriod', 'timePeriod']) AS kind, unnest(['next ' || wd, day, hour, 'next ' || wd || ' at ' || hour, day, period, part]) AS value,
  unnest([NULL, NULL, NULL, NULL, NULL, ['week', 'month', 'year'][id % 3 + 1], NULL]) AS unit FROM said)"""


@query(f"WITH {CALENDAR} SELECT id, kind, (position(value IN text) - 1)::BIGINT AS s, (position(value IN text) - 1 + length(value))::BIGINT AS e, value, unit FROM marks")
def builtin_calendar(spark, sf_dir):
    """Dates, times, their joins and periods in requests made of the customers' keys."""
    k = F.col("c_custkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    hour = F.concat((k % 12 + 1).cast("string"), F.when(k % 2 == 0, " am").otherwise(" pm"))
    day = F.concat_ws(" ", pick(_MONTHS, k % 12), (k % 28 + 1).cast("string"))
    period = F.concat_ws(" ", pick(("this", "next", "last"), k % 3), pick(("week", "month", "year"), k % 3))
    said = F.concat(F.lit("Visit next "), pick(_DAYS, k % 7), F.lit(" at "), hour, F.lit(" or "), day, F.lit(", "), period, F.lit(" in the "), pick(("morning", "afternoon", "evening", "night"), k % 4), F.lit("."))
    texts = table(spark, sf_dir, "customer").select(k.cast("long").alias("id"), said.alias("text"))
    return entities.builtin_matches(texts, ["id"], ("date", "time", "datetime", "datePeriod", "timePeriod")).select("id", "kind", "s", "e", "value", "unit")


#: Numbers below 10 ** 9 of each customer, of one to nine digits, in words of each language that has some. The French un is an article as well, so it is no number alone.
WORD_NUMBERS = "said AS (" + " UNION ALL ".join(
    f"SELECT c_custkey AS id, '{lang}' AS lang, n, {spoken.spelled_sql('n', lang)} AS words FROM (SELECT c_custkey, 2 + (c_custkey * 98317 + c_custkey * c_custkey * 7919) % (CASE c_custkey % 3 WHEN 0 THEN 97 WHEN 1 THEN 99991 ELSE 999999000 END) AS n FROM customer)" for lang in spoken.LANGUAGES
) + ")"


@query(f"WITH {WORD_NUMBERS} SELECT id, lang, 3::BIGINT AS s, (3 + length(words))::BIGINT AS e, words AS value, n::DOUBLE AS number FROM said")
def builtin_word_numbers(spark, sf_dir):
    """Numbers that are read from words, made of the customers' keys."""
    k = F.col("c_custkey")
    n = 2 + (k * 98317 + k * k * 7919) % F.when(k % 3 == 0, 97).when(k % 3 == 1, 99_991).otherwise(999_999_000)
    numbers, out = table(spark, sf_dir, "customer").select(k.cast("long").alias("id"), n.cast("long").alias("n")), None
    for lang in spoken.LANGUAGES:
        texts = numbers.select("id", F.lit(lang).alias("lang"), F.concat(F.lit("(: "), spoken.spell(F.col("n"), lang), F.lit(", ok")).alias("text"))
        own = entities.builtin_matches(texts, ["id", "lang"], ("number",), lang).select("id", "lang", "s", "e", "value", "number")
        out = own if out is None else out.unionByName(own)
    return out


_at = lambda words, i: f"{_list(words)}[{i}]"
#: Requests with a duration of three parts, an interval of hours, one of weekdays, and an open one.
COMPOUNDS = f"""parts AS (SELECT c_custkey AS id, (c_custkey % 5 + 2)::VARCHAR || ' days, ' || (c_custkey % 20 + 2)::VARCHAR || ' hours and ' || (c_custkey % 58 + 2)::VARCHAR || ' minutes' AS stay, ((c_custkey % 5 + 2) * 24 + c_custkey % 20 + 2) * 60 + c_custkey % 58 + 2 AS minutes,
  'between ' || (c_custkey % 5 + 1)::VARCHAR || ' and ' || (c_custkey % 5 + 7)::VARCHAR || ' pm' AS hours, 'from ' || {_at(_DAYS, "c_custkey % 7 + 1")} || ' to ' || {_at(_DAYS, "(c_custkey + 3) % 7 + 1")} AS days, ['before ', 'after '][c_custkey % 2 + 1] || ['noon', 'midnight'][c_custkey % 2 + 1] AS open, c_custkey % 2 AS late FROM customer
), whole AS (SELECT *, 'Stay ' || stay || ' ' || hours || '; ' || days || ', ' || open || '.' AS text FROM parts)"""


@query(
    f"""WITH {COMPOUNDS}, marks AS (SELECT id, text, unnest(['duration', 'timePeriod', 'datePeriod', 'timePeriod']) AS kind, unnest([stay, hours, days, open]) AS value, unnest([minutes, NULL, NULL, NULL])::DOUBLE AS number,
  unnest(['minute', 'interval', 'interval', CASE WHEN late = 1 THEN 'after' ELSE 'before' END]) AS unit FROM whole)
SELECT id, kind, (position(value IN text) - 1)::BIGINT AS s, (position(value IN text) - 1 + length(value))::BIGINT AS e, value, number, unit FROM marks"""
)
def builtin_compounds(spark, sf_dir):
    """Durations of several parts, and intervals of times and dates, in requests made of the customers' keys."""
    k = F.col("c_custkey")
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), n.cast("int"))
    number = lambda n: n.cast("string")
    stay = F.concat(number(k % 5 + 2), F.lit(" days, "), number(k % 20 + 2), F.lit(" hours and "), number(k % 58 + 2), F.lit(" minutes"))
    hours = F.concat(F.lit("between "), number(k % 5 + 1), F.lit(" and "), number(k % 5 + 7), F.lit(" pm"))
    days = F.concat(F.lit("from "), pick(_DAYS, k % 7), F.lit(" to "), pick(_DAYS, (k + 3) % 7))
    said = F.concat(F.lit("Stay "), stay, F.lit(" "), hours, F.lit("; "), days, F.lit(", "), pick(("before noon", "after midnight"), k % 2), F.lit("."))
    texts = table(spark, sf_dir, "customer").select(k.cast("long").alias("id"), said.alias("text"))
    return entities.builtin_matches(texts, ["id"], ("duration", "timePeriod", "datePeriod"))


_MONDAY = "date_trunc('week', ref)"
_MEANING = f"""refs AS (SELECT *, TIMESTAMP '1995-11-03 10:30:00' + to_days((id * 37 % 3000)::INT) + to_hours((id % 13)::INT) AS ref FROM cal
), parts AS (SELECT *, date_trunc('day', ref) AS today, id % 12 + 1 AS mon, id % 28 + 1 AS dom, (id % 12 + 1) % 12 + CASE WHEN id % 2 = 0 THEN 0 ELSE 12 END AS hh FROM refs
), days AS (SELECT *, {_MONDAY} + to_days((7 + id % 7)::INT) AS next_wd, today + to_days(((id % 7 - (isodow(ref) - 1) + 6 + 7) % 7 + 1)::INT) AS bare_wd,
  (SELECT min(d) FROM (SELECT make_date((year(ref) + y)::INT, mon::INT, dom::INT) AS d FROM (SELECT unnest([0, 1]) AS y)) WHERE d >= today)::TIMESTAMP AS of_month,
  today + to_hours(hh::INT) + CASE WHEN today + to_hours(hh::INT) > ref THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END AS of_hour,
  CASE id % 3 WHEN 0 THEN {_MONDAY} WHEN 1 THEN date_trunc('month', ref) + INTERVAL 1 MONTH ELSE date_trunc('year', ref) - INTERVAL 1 YEAR END AS starts, CASE id % 3 WHEN 0 THEN INTERVAL 7 DAY WHEN 1 THEN INTERVAL 1 MONTH ELSE INTERVAL 1 YEAR END AS size,
  [6, 12, 18, 22][id % 4 + 1] AS from_h, [12, 18, 22, 30][id % 4 + 1] AS to_h FROM parts
), meant AS (
  SELECT id, unnest(['date', 'date', 'date', 'time', 'datetime', 'datePeriod', 'timePeriod', 'datePeriod', 'timePeriod']) AS kind,
    unnest(['next ' || wd, wd, day, hour, 'next ' || wd || ' at ' || hour, period, part, 'from ' || wd || ' to ' || ['sunday', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday'][id % 7 + 1], 'after ' || hour]) AS value,
    unnest([next_wd, bare_wd, of_month, of_hour, next_wd + to_hours(hh::INT), NULL, NULL, NULL, NULL]) AS moment,
    unnest(['Day', 'Day', 'Day', 'Hour', 'Hour', NULL, NULL, NULL, NULL]) AS grain,
    unnest([NULL, NULL, NULL, NULL, NULL, starts, today + to_hours(from_h::INT) + skip, bare_wd, of_hour]) AS a, unnest([NULL, NULL, NULL, NULL, NULL, starts + size, today + to_hours(to_h::INT) + skip, bare_wd + INTERVAL 6 DAY, NULL]) AS b
  FROM (SELECT *, CASE WHEN today + to_hours(to_h::INT) <= ref THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS skip FROM days))"""


@query(
    f"""WITH {CALENDAR.partition(chr(10) + "), said AS")[0]}), {_MEANING}
SELECT id, kind, value, CASE WHEN a IS NULL AND b IS NULL THEN 'InstantTime' ELSE 'TimeInterval' END AS means, strftime(moment, '%Y-%m-%d %H:%M:%S +00:00') AS instant, grain, strftime(a, '%Y-%m-%d %H:%M:%S +00:00') AS begins, strftime(b, '%Y-%m-%d %H:%M:%S +00:00') AS ends FROM meant"""
)
def builtin_resolved(spark, sf_dir):
    """What dates, times and periods mean at instants that differ from customer to customer."""
    k = F.col("c_custkey")
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), n.cast("int"))
    hour, wd = F.concat((k % 12 + 1).cast("string"), F.when(k % 2 == 0, " am").otherwise(" pm")), pick(_DAYS, k % 7)
    said = {
        0: ("date", F.concat(F.lit("next "), wd)), 1: ("date", wd), 2: ("date", F.concat_ws(" ", pick(_MONTHS, k % 12), (k % 28 + 1).cast("string"))), 3: ("time", hour), 4: ("datetime", F.concat(F.lit("next "), wd, F.lit(" at "), hour)),
        5: ("datePeriod", F.concat_ws(" ", pick(("this", "next", "last"), k % 3), pick(("week", "month", "year"), k % 3))), 6: ("timePeriod", pick(("morning", "afternoon", "evening", "night"), k % 4)),
        7: ("datePeriod", F.concat(F.lit("from "), wd, F.lit(" to "), pick((_DAYS[-1], *_DAYS[:-1]), k % 7))), 8: ("timePeriod", F.concat(F.lit("after "), hour)),
    }
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in said.values()])).alias("x")
    reference = F.expr("timestamp'1995-11-03 10:30:00' + make_dt_interval(cast(c_custkey * 37 % 3000 as int), cast(c_custkey % 13 as int))")
    rows = table(spark, sf_dir, "customer").select(k.cast("long").alias("id"), reference.alias("ref"), each).select("id", "ref", "x.*")
    meant = calendar.with_meaning(rows, "kind", "value", F.col("ref"))
    return meant.select("id", "kind", "value", F.col("meant.kind").alias("means"), F.col("meant.value").alias("instant"), "meant.grain", F.col("meant.from").alias("begins"), F.col("meant.to").alias("ends"))


@query(
    f"""WITH {gen.DICTIONARY}, loose AS (SELECT *, string_split(norm, ' ') AS w, len(string_split(norm, ' ')) AS n FROM entries WHERE kind = 'product'
), sized AS (SELECT *, unnest(range(greatest(1, ceil(0.5 * n))::BIGINT, n::BIGINT)) AS k FROM loose), placed AS (SELECT *, unnest(range(1, n - k + 2)) AS a FROM sized
), cut AS (SELECT kind, array_to_string(w[a : a + k - 1], ' ') AS norm, k, resolved, k / n AS share FROM placed
), best AS (SELECT kind, norm, k, arg_min(resolved, struct_pack(a := -share, b := resolved)) AS resolved FROM cut GROUP BY kind, norm, k)
SELECT kind, norm, len(string_split(norm, ' '))::BIGINT AS n_tokens, resolved FROM entries UNION ALL SELECT kind, norm, k, resolved FROM best ANTI JOIN entries USING (kind, norm)"""
)
def gazetteer_strictness(spark, sf_dir):
    """The dictionary with the parts that products match by at a strictness of one half."""
    strict = spark.sql("SELECT 'product' AS kind, 0.5D AS strictness UNION ALL SELECT 'brand', 1.0D")
    return entities.with_parts(gen.entries(spark, sf_dir), strict).withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query(f"WITH {gen.MATCHES} SELECT id, kind, s, e, value, resolved FROM gaz")
def gazetteer_match(spark, sf_dir):
    return entities.gazetteer_matches(gen.utterances(spark, sf_dir), ["id"], gen.entries(spark, sf_dir))


#: Names of up to four words with their type in front and their brand's number behind, and requests in which one of the words is missing.
GAPS = """named AS (SELECT p_partkey AS id, lower(p_type) || ' ' || p_name || ' ' || regexp_extract(p_brand, '[0-9]+') AS norm FROM part
), dict AS (SELECT DISTINCT norm, string_split(norm, ' ') AS w FROM named
), said AS (SELECT id, 'get ' || array_to_string(list_filter(string_split(norm, ' '), lambda x, i: i <> id % 5 + 1), ' ') || ' and ' || string_split(norm, ' ')[1] || ' now' AS text FROM named
), toks AS (SELECT id, text, string_split(text, ' ') AS t FROM said
), starts AS (SELECT id, text, t, unnest(range(1, len(t) + 1)) AS a FROM toks
), runs AS (SELECT id, text, a, k, t[a : a + k - 1] AS r, len(array_to_string(t[1 : a - 1], ' ')) + CASE WHEN a > 1 THEN 1 ELSE 0 END AS s FROM (SELECT *, unnest(range(2, 5)) AS k FROM starts) WHERE a + k - 1 <= len(t)
), filed AS (SELECT norm, w, unnest(list_distinct(w)) AS word FROM dict
), fits AS (SELECT id, a, k, s, array_to_string(r, ' ') AS value, norm, len(w) AS n FROM runs JOIN filed ON r[1] = word AND 2 * k >= len(w) AND '  ' || replace(norm, ' ', '  ') || '  ' LIKE '% ' || array_to_string(r, ' % ') || ' %'
), whole AS (SELECT * FROM fits f WHERE NOT EXISTS (SELECT 1 FROM fits g WHERE g.id = f.id AND g.norm = f.norm AND g.a <= f.a AND f.a + f.k <= g.a + g.k AND g.k > f.k))"""


@query(f"WITH {GAPS} SELECT id, s::BIGINT AS s, (s + length(value))::BIGINT AS e, value, arg_min(norm, struct_pack(a := -k / n, b := norm)) AS resolved, max(k / n) AS share FROM whole GROUP BY id, s, value")
def gazetteer_gaps(spark, sf_dir):
    """Requests for names of which a word is missing, against the dictionary of whole names, at a strictness of one half."""
    part = table(spark, sf_dir, "part")
    norm = F.concat_ws(" ", F.lower("p_type"), "p_name", F.regexp_extract("p_brand", "[0-9]+", 0))
    named = part.select(F.col("p_partkey").cast("long").alias("id"), norm.alias("norm"))
    words = F.split("norm", " ")
    said = F.concat(F.lit("get "), F.array_join(F.filter(words, lambda x, i: i != F.col("id") % 5), " "), F.lit(" and "), F.get(words, F.lit(0)), F.lit(" now"))
    entries = entities.gazetteer(named.select(F.lit("item").alias("kind"), F.col("norm").alias("surface"), F.col("norm").alias("resolved")).distinct())
    strict = spark.createDataFrame([("item", 0.5)], "kind string, strictness double")
    return entities.gapped_matches(named.select("id", said.alias("text")), ["id"], entries, strict).select("id", "s", "e", "value", "resolved", "share")


@query(f"WITH {gen.KEPT} SELECT id, kind, s, e, value, resolved FROM kept")
def gazetteer_dedupe(spark, sf_dir):
    return gen.kept(spark, sf_dir)


@query(f"WITH {gen.REWRITTEN} SELECT id, rewritten FROM rewritten")
def placeholders(spark, sf_dir):
    return gen.rewritten(spark, sf_dir)[0]


@query(f"WITH {gen.REWRITTEN} SELECT id, n, kind, s, e, new_s, new_e FROM ranged")
def placeholder_ranges(spark, sf_dir):
    return gen.rewritten(spark, sf_dir)[1].drop("value")


@query(f"WITH {gen.MATCHES} SELECT id, a.kind AS left_kind, a.s AS left_s, b.kind AS right_kind, b.s AS right_s FROM (SELECT id, ms[i] AS a, unnest(ms[i + 1 :]) AS b FROM (SELECT id, ms, unnest(range(1, len(ms))) AS i FROM (SELECT id, list(struct_pack(s := s, e := e, kind := kind) ORDER BY s, e, kind) AS ms FROM matches GROUP BY id))) WHERE a.s < b.e AND b.s < a.e")
def range_overlap_pairs(spark, sf_dir):
    """An utterance's matches are few, so they are paired within its row, and found once."""
    held = gen.matches(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind"))).alias("ms"))

    def later(a, i):
        over = F.filter(F.slice("ms", i + 2, F.size("ms")), lambda b: (a["s"] < b["e"]) & (b["s"] < a["e"]))
        return F.transform(over, lambda b: F.struct(a["kind"].alias("left_kind"), a["s"].alias("left_s"), b["kind"].alias("right_kind"), b["s"].alias("right_s")))

    return each(held, ["id"], F.flatten(F.transform("ms", later)), "x").select("id", "x.*")


@query(f"WITH {gen.REWRITTEN} SELECT t.id, t.i, coalesce(arg_max(r.new_e - r.e, r.e), 0)::BIGINT AS shift FROM toks t LEFT JOIN ranged r ON t.id = r.id AND r.e <= t.s GROUP BY t.id, t.i")
def range_shift_asof(spark, sf_dir):
    """How far each token moves in the rewritten text: the shift of the last replaced range that ends before it."""
    from parlance.functions.text import tokens

    toks = tokens(gen.utterances(spark, sf_dir), ["id"]).select("id", "i", "s")
    ranges = gen.rewritten(spark, sf_dir)[1].select("id", F.col("e").alias("end"), (F.col("new_e") - F.col("e")).alias("by"))
    joined = joins.by_key(toks, ranges, "id", "left")
    before = F.when(F.col("end") <= F.col("s"), F.col("end"))
    return joined.groupBy("id", "i").agg(F.coalesce(F.max_by("by", before), F.lit(0)).cast("long").alias("shift"))


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text) WHERE length(benchmark.text) > 0")
def phrase_dictionary(spark, sf_dir):
    """Documents that hold a dictionary's phrase verbatim. A phrase is filed under its second to fourth word; a document's runs of
    three words fetch the phrases to look for, so no document meets all of them."""
    cut = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    from pyspark.sql import Window as W

    key = F.array_join(F.slice(cut(F.col("phrase")), 2, 3), " ")
    long = items.withColumn("key", key).where(F.size(cut(F.col("phrase"))) >= 5)
    by = W.partitionBy("doc_id").orderBy("pos")
    words = docs.select("doc_id", F.posexplode(cut(F.col("text"))).alias("pos", "w"))
    grams = words.select("doc_id", F.concat_ws(" ", "w", F.lead("w", 1).over(by), F.lead("w", 2).over(by)).alias("key"))
    near = grams.join(long, "key").select("doc_id", "item_id", "phrase").distinct()
    found = near.join(docs, "doc_id").where(F.contains("text", "phrase")).select("doc_id", "item_id")
    short = items.where((F.size(cut(F.col("phrase"))) < 5) & (F.length("phrase") > 0))
    return found.unionByName(docs.join(short, F.contains("text", "phrase")).select("doc_id", "item_id"))


@query(
    f"""WITH {gen.MATCHES}, inside AS (SELECT t.id, t.i, m.kind, m.s AS ms, m.e AS me FROM toks t JOIN matches m ON t.id = m.id AND m.s <= t.s AND t.e <= m.e),
firsts AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY id, i, kind ORDER BY ms, me) = 1)
SELECT id, i, kind, CASE WHEN row_number() OVER (PARTITION BY id, kind, ms, me ORDER BY i) = 1 THEN 'B-' ELSE 'I-' END AS tag FROM firsts"""
)
def entity_match_feature(spark, sf_dir):
    from parlance.functions.text import tokens

    return entities.covering(tokens(gen.utterances(spark, sf_dir), ["id"]), gen.matches(spark, sf_dir), ["id"], "BIO")
