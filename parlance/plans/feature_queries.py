"""Term statistics, tags, samples and metrics over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import entities, features, metrics, sampling, tagging
from parlance.operators.token_features import FeatureConfig, token_features
from parlance.plans import gen
from parlance.plans.lexicon_queries import DOC_TOP, words
from parlance.plans.parser_queries import TRAINED, trained
from parlance.plans.registry import normal_sql, query
from parlance.plans.text_queries import DOC, SHAPE_SQL, TURN, TURN_KEYS, doc_words, turn_words
from parlance.session import table
from parlance.streaming.windows import counts_by_window


def counts(spark, sf_dir):
    return features.term_counts(doc_words(spark, sf_dir), "doc_id", text.normalize(F.col("value")))


COUNTS = f"{DOC}, counts AS (SELECT doc_id, {normal_sql('value')} AS term, count(*) AS tf FROM toks GROUP BY 1, 2)"
IDF = f"{COUNTS}, idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(DISTINCT doc_id) FROM counts)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term)"


@query(f"WITH {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_fit(spark, sf_dir):
    return features.document_frequencies(counts(spark, sf_dir), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {IDF}, raw AS (SELECT doc_id, term, tf * idf AS raw FROM counts JOIN idf USING (term)) SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS w FROM raw")
def tfidf_transform(spark, sf_dir):
    c = counts(spark, sf_dir)
    return features.weights(c, features.document_frequencies(c, "doc_id"), "doc_id").withColumn("w", F.round("w", 6))


@query(f"WITH {IDF}, kept AS (SELECT DISTINCT {normal_sql('unnest(regexp_extract_all(text, $$[\\p{L}\\p{N}_]+|[$%!?&]$$))')} AS term FROM conversations) SELECT row_number() OVER (ORDER BY term) - 1 AS idx, term, round(idf, 6) AS idf FROM idf SEMI JOIN kept USING (term)")
def vocab_restrict(spark, sf_dir):
    """The documents' vocabulary restricted to what conversations say."""
    said = turn_words(spark, sf_dir).select(text.normalize(F.col("value")).alias("term"))
    return features.restrict(features.document_frequencies(counts(spark, sf_dir), "doc_id"), said).withColumn("idf", F.round("idf", 6))


CHI2 = f"""{COUNTS}, cls AS (SELECT doc_id, quality AS class FROM labels), share AS (SELECT class, count(*) / sum(count(*)) OVER () AS share FROM cls GROUP BY class),
obs AS (SELECT term, class, sum(tf) AS o FROM counts JOIN cls USING (doc_id) GROUP BY 1, 2), tot AS (SELECT term, sum(o) AS total FROM obs GROUP BY term),
chi AS (SELECT term, sum(pow(coalesce(o, 0) - total * share, 2) / (total * share)) AS stat FROM tot CROSS JOIN share LEFT JOIN obs USING (term, class) GROUP BY term)"""
#: The statistic at p = 0.4 with one degree of freedom, as two classes have.
CRITICAL = 0.7083263008882452


def chi2(spark, sf_dir):
    classes = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("class"))
    return features.chi2(counts(spark, sf_dir), classes, "doc_id")


@query(f"WITH {CHI2} SELECT term, round(stat, 6) AS stat FROM chi")
def chi2_scores(spark, sf_dir):
    return chi2(spark, sf_dir).withColumn("stat", F.round("stat", 6))


@query(f"WITH {CHI2} SELECT term, round(stat, 6) AS stat FROM chi WHERE stat > {CRITICAL} OR ((SELECT max(stat) FROM chi) <= {CRITICAL} AND stat = (SELECT max(stat) FROM chi))")
def chi2_select(spark, sf_dir):
    return features.select_terms(chi2(spark, sf_dir), features.chi2_critical(spark, 0.4, 1)).withColumn("stat", F.round("stat", 6))


def _pairs(ordered: bool) -> str:
    w1, w2 = ("a.v", "b.v") if ordered else ("least(a.v, b.v)", "greatest(a.v, b.v)")
    return f"{TURN}, low AS (SELECT *, lower(value) AS v FROM toks), pairs AS (SELECT DISTINCT a.conv_id, a.turn, {w1} AS w1, {w2} AS w2 FROM low a JOIN low b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.i BETWEEN a.i + 1 AND a.i + 3), vocab AS (SELECT w1, w2, count(*) AS n FROM pairs GROUP BY 1, 2)"


def pairs(spark, sf_dir, ordered=True):
    return features.text_pairs(table(spark, sf_dir, "conversations").select(*TURN_KEYS, "text"), TURN_KEYS, 3, ordered)


@query(f"WITH {_pairs(True)} SELECT w1, w2, n FROM vocab")
def cooc_pairs(spark, sf_dir):
    return features.pair_vocabulary(pairs(spark, sf_dir))


@query(f"WITH {_pairs(False)} SELECT w1, w2, n FROM vocab")
def cooc_pairs_unordered(spark, sf_dir):
    return features.pair_vocabulary(pairs(spark, sf_dir, False))


@query(f"WITH {_pairs(True)} SELECT w1, w2, n FROM vocab ORDER BY n DESC, w1, w2 LIMIT 100")
def cooc_topk(spark, sf_dir):
    return features.pair_vocabulary(pairs(spark, sf_dir)).orderBy(F.desc("n"), "w1", "w2").limit(100)


@query(f"WITH {_pairs(True)}, top AS (SELECT w1, w2 FROM vocab ORDER BY n DESC, w1, w2 LIMIT 100) SELECT conv_id, turn, w1 || '+' || w2 AS feature FROM pairs SEMI JOIN top USING (w1, w2)")
def cooc_transform(spark, sf_dir):
    top = cooc_topk(spark, sf_dir).select("w1", "w2")
    return pairs(spark, sf_dir).join(top, ["w1", "w2"], "left_semi").select(*TURN_KEYS, F.concat_ws("+", "w1", "w2").alias("feature"))


@query("SELECT quality AS class, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)) * CASE WHEN quality = max(quality) OVER () THEN 0.5 ELSE 1 END, 6)::DOUBLE AS weight FROM labels GROUP BY quality")
def class_weights(spark, sf_dir):
    return features.class_weights(table(spark, sf_dir, "labels").select(F.col("quality").alias("class")), 0.5).withColumn("weight", F.round("weight", 6))


@query("SELECT round(1 / (4 * (sum(n) + 5 * avg(n))), 12)::DOUBLE AS alpha FROM (SELECT role, count(*) AS n FROM conversations GROUP BY role)")
def reg_factor(spark, sf_dir):
    return features.regularisation(table(spark, sf_dir, "conversations").select(F.col("role").alias("intent"))).withColumn("alpha", F.round("alpha", 12))


@query(f"WITH {TURN}, n AS (SELECT conv_id, turn, count(*) AS n FROM toks GROUP BY 1, 2) SELECT role, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM n JOIN conversations USING (conv_id, turn) GROUP BY role")
def utt_length_stats(spark, sf_dir):
    n = turn_words(spark, sf_dir).groupBy(*TURN_KEYS).agg(F.count("*").alias("n"))
    joined = n.join(table(spark, sf_dir, "conversations").select(*TURN_KEYS, "role"), TURN_KEYS)
    return joined.groupBy("role").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"))


_prefix = {
    "IO": "'I-'",
    "BIO": "CASE WHEN p = 1 THEN 'B-' ELSE 'I-' END",
    "BILOU": "CASE WHEN c = 1 THEN 'U-' WHEN p = 1 THEN 'B-' WHEN p = c THEN 'L-' ELSE 'I-' END",
}
_starts = {
    "IO": "b = 'O'",
    "BIO": "(starts_with(tag, 'B-') OR b = 'O')",
    "BILOU": "(starts_with(tag, 'B-') OR starts_with(tag, 'U-') OR starts_with(b, 'U-') OR starts_with(b, 'L-') OR b = 'O')",
}


def _tags_sql(scheme: str) -> str:
    return f"""{gen.TOKS}, {gen.SLOTS}, held AS (SELECT t.id, t.i, t.s, t.e, l.n, l.slot_name FROM toks t LEFT JOIN slots l ON t.id = l.id AND l.s <= t.s AND t.e <= l.e), placed AS (
  SELECT *, row_number() OVER (PARTITION BY id, n ORDER BY i) AS p, count(*) OVER (PARTITION BY id, n) AS c FROM held
), tags AS (SELECT id, i, CASE WHEN n IS NULL THEN 'O' ELSE {_prefix[scheme]} || slot_name END AS tag, s, e FROM placed)"""


def tags(spark, sf_dir, scheme):
    return tagging.encoded(gen.utterances(spark, sf_dir), gen.slots(spark, sf_dir), ["id"], scheme)


def _encode(scheme):
    def run(spark, sf_dir):
        return text.each(tags(spark, sf_dir, scheme), ["id"], F.col("tags"), "t").select("id", "t.*")

    run.__name__ = f"{scheme.lower()}_encode"
    query(f"WITH {_tags_sql(scheme)} SELECT id, i, tag, s, e FROM tags")(run)


def _decode(scheme):
    def run(spark, sf_dir):
        return text.each(tags(spark, sf_dir, scheme), ["id"], tagging.decoded(F.col("tags"), scheme), "x").select("id", "x.*")

    run.__name__ = f"{scheme.lower()}_decode"
    query(
        f"""WITH {_tags_sql(scheme)}, near AS (SELECT *, coalesce(lag(tag) OVER (PARTITION BY id ORDER BY i), 'O') AS b FROM tags),
isl AS (SELECT *, sum(CASE WHEN tag <> 'O' AND {_starts[scheme]} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS island FROM near)
SELECT id, substr(arg_max(tag, i), 3) AS slot_name, min(s) AS s, max(e) AS e FROM isl WHERE tag <> 'O' GROUP BY id, island"""
    )(run)


_ends = {
    "IO": "a = 'O'",
    "BIO": "(a = 'O' OR starts_with(a, 'B-'))",
    "BILOU": "(a = 'O' OR starts_with(a, 'B-') OR starts_with(a, 'U-') OR starts_with(tag, 'L-') OR starts_with(tag, 'U-'))",
}


def _bounds(scheme):
    def run(spark, sf_dir):
        def one(t, i):
            before, after = tagging.near(F.col("tags"), i - 1), tagging.near(F.col("tags"), i + 1)
            return F.struct(t["i"].alias("i"), tagging.starts(t["tag"], before, scheme).alias("starts"), tagging.ends(t["tag"], after, scheme).alias("ends"))

        return text.each(tags(spark, sf_dir, scheme), ["id"], F.transform("tags", one), "x").select("id", "x.*")

    run.__name__ = f"{scheme.lower()}_bounds"
    query(
        f"""WITH {_tags_sql(scheme)}, near AS (SELECT *, coalesce(lag(tag) OVER w, 'O') AS b, coalesce(lead(tag) OVER w, 'O') AS a FROM tags WINDOW w AS (PARTITION BY id ORDER BY i))
SELECT id, i, tag <> 'O' AND {_starts[scheme]} AS starts, tag <> 'O' AND {_ends[scheme]} AS ends FROM near"""
    )(run)


for _scheme in tagging.SCHEMES:
    _encode(_scheme)
    _decode(_scheme)
    _bounds(_scheme)


FEATURES = (
    FeatureConfig("ngram", {"n": 1}, (-1, 0)), FeatureConfig("ngram", {"n": 2}), FeatureConfig("shape_ngram", {"n": 1}), FeatureConfig("prefix", {"prefix_size": 2}), FeatureConfig("suffix", {"suffix_size": 3}),
    FeatureConfig("is_digit"), FeatureConfig("is_first"), FeatureConfig("is_last"), FeatureConfig("length", offsets=(1,)), FeatureConfig("builtin_entity_match", {"tagging_scheme": "BIO"}),
)


@query(
    f"""WITH {gen.BUILTIN}, near AS (SELECT *, {normal_sql('value')} AS v, row_number() OVER w AS r, count(*) OVER (PARTITION BY id) AS c, lag({normal_sql('value')}) OVER w AS back, lead({normal_sql('value')}) OVER w AS one, lead(value) OVER w AS after FROM toks WINDOW w AS (PARTITION BY id ORDER BY i)),
plain AS (SELECT id, i, unnest(['ngram_1[-1]=' || back, 'ngram_1=' || v, 'ngram_2=' || v || ' ' || one, 'shape_ngram_1=' || {SHAPE_SQL}, CASE WHEN length(v) >= 2 THEN 'prefix_2=' || left(v, 2) END, CASE WHEN length(v) >= 3 THEN 'suffix_3=' || right(v, 3) END,
  CASE WHEN regexp_full_match(value, '[0-9]+') THEN 'is_digit=1' END, CASE WHEN r = 1 THEN 'is_first=1' END, CASE WHEN r = c THEN 'is_last=1' END, 'length[+1]=' || length(after)::VARCHAR]) AS feature FROM near)
SELECT id, i, feature FROM plain WHERE feature IS NOT NULL UNION ALL
SELECT t.id, t.i, 'builtin_entity_match_BIO=' || CASE WHEN t.s = m.s THEN 'B-' ELSE 'I-' END || m.kind FROM toks t JOIN builtin m ON t.id = m.id AND m.s <= t.s AND t.e <= m.e AND m.kind IN ('percentage', 'duration')"""
)
def configured_features(spark, sf_dir):
    """Token features as a slot filler's configuration names them."""
    texts = gen.utterances(spark, sf_dir)
    found = entities.builtin_matches(texts, ["id"], ("percentage", "duration"))
    made = token_features(texts, found, features=FEATURES)
    return made.select("id", F.explode("tokens").alias("t")).select("id", "t.i", F.explode("t.features").alias("feature"))


PAIR_CHI2 = f"""{_pairs(True)}, counts AS (SELECT conv_id, turn, w1 || ' ' || w2 AS term FROM pairs), share AS (SELECT role AS class, count(*) / sum(count(*)) OVER () AS share FROM conversations GROUP BY role),
obs AS (SELECT term, role AS class, count(*) AS o FROM counts JOIN conversations USING (conv_id, turn) GROUP BY 1, 2), tot AS (SELECT term, sum(o) AS total FROM obs GROUP BY term),
chi AS (SELECT term, sum(pow(coalesce(o, 0) - total * share, 2) / (total * share)) AS stat FROM tot CROSS JOIN share LEFT JOIN obs USING (term, class) GROUP BY term)"""


@query(f"WITH {PAIR_CHI2} SELECT term, round(stat, 6) AS stat FROM chi ORDER BY round(stat, 6) DESC, term LIMIT 200")
def cooc_select(spark, sf_dir):
    """The word pairs that tell the roles of a conversation apart best, by chi-square."""
    key = F.concat_ws(":", "conv_id", "turn").alias("key")
    counted = pairs(spark, sf_dir).select(key, F.concat_ws(" ", "w1", "w2").alias("term"), F.lit(1).alias("tf"))
    classes = table(spark, sf_dir, "conversations").select(key, F.col("role").alias("class"))
    return features.chi2(counted, classes, "key").select("term", F.round("stat", 6).alias("stat")).orderBy(F.desc("stat"), "term").limit(200)


@query(
    f"""WITH {gen.TOKS}, kw AS (SELECT string_split(p_name, ' ')[-1] AS keyword, arg_max(p_brand, p_partkey) AS entity FROM part GROUP BY 1)
SELECT id, s, e, value, entity, 'thing' AS slot_name FROM toks JOIN kw ON keyword = lower(value)"""
)
def keyword_slots(spark, sf_dir):
    last = F.element_at(F.split("p_name", " "), -1)
    keywords = table(spark, sf_dir, "part").select(last.alias("keyword"), F.col("p_brand").alias("entity"), F.lit("thing").alias("slot_name"), F.col("p_partkey").alias("ord"))
    return tagging.keyword_slots(text.tokens(gen.utterances(spark, sf_dir), ["id"]), keywords, ["id"], lowercase=True)


@query(
    f"""WITH {TRAINED}, t AS (SELECT intent, template, row_number() OVER (PARTITION BY intent ORDER BY md5('3:' || template), template) - 1 AS k, count(*) OVER (PARTITION BY intent) AS n
  FROM (SELECT DISTINCT intent, trained AS template FROM trained)),
v AS (SELECT mark, value, row_number() OVER (PARTITION BY mark ORDER BY md5('3:' || value), value) - 1 AS k, count(*) OVER (PARTITION BY mark) AS n
  FROM (SELECT DISTINCT '%' || upper(entity) || '%' AS mark, raw_value AS value FROM slots WHERE entity IN ('product', 'brand', 'priority'))),
filled AS (SELECT t.intent, i, template FROM range(400) r(i) JOIN t ON t.k = i % t.n)
SELECT f.intent, f.i, replace(replace(replace(template, '%PRODUCT%', (SELECT value FROM v WHERE mark = '%PRODUCT%' AND k = f.i % n)), '%BRAND%', (SELECT value FROM v WHERE mark = '%BRAND%' AND k = f.i % n)),
 '%PRIORITY%', (SELECT value FROM v WHERE mark = '%PRIORITY%' AND k = f.i % n)) AS generated FROM filled f"""
)
def augment_cyclic(spark, sf_dir):
    templates = trained(spark, sf_dir).select("intent", F.col("rewritten").alias("template"))
    custom = gen.slots(spark, sf_dir).where(F.col("entity").isin("product", "brand", "priority"))
    values = custom.select(text.placeholder(F.col("entity")).alias("mark"), F.col("raw_value").alias("value"))
    return sampling.augment(templates, values, 400, 3)


_draw = lambda seed, key: f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::UBIGINT / 4294967296)"


@query(
    f"""SELECT p_partkey, CASE WHEN {_draw(5, 'p_partkey::VARCHAR')} <= 0.2 THEN list_reduce(list_prepend('', list_transform(regexp_extract_all(lower(p_name), '[a-z]+|[^a-z]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2)))), lambda a, b: a || b)
ELSE lower(p_name) END AS spoken FROM part"""
)
def capitalize_sample(spark, sf_dir):
    return sampling.capitalise(table(spark, sf_dir, "part"), "p_partkey", "p_name", 0.2, 5)


@query(
    f"""WITH {DOC_TOP}, w AS (SELECT list(word ORDER BY rank) AS words FROM top WHERE rank <= 100), sized AS (
  SELECT p_partkey AS i, greatest(1, floor(5 + 2 * sqrt(-2 * ln(1 - {_draw(11, 'p_partkey::VARCHAR')})) * cos(2 * 3.141592653589793 * {_draw(12, 'p_partkey::VARCHAR')})))::INT AS size FROM part)
SELECT i, array_to_string(list_transform(range(size), lambda j: words[(i * 7 + j) % len(words) + 1]), ' ') AS noise FROM sized, w"""
)
def noise_words(spark, sf_dir):
    listed = words(spark, sf_dir, 100).select((F.col("rank") - 1).alias("ord"), "word")
    return sampling.noise(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i")), listed, 5.0, 2.0, 11)


@query(
    f"""WITH {DOC_TOP}, {TURN.replace('pieces', 'tpieces').replace('ends', 'tends').replace('toks', 'ttoks')}, w AS (SELECT word FROM top WHERE rank <= 500),
s AS (SELECT conv_id, turn, string_agg(CASE WHEN word IS NULL THEN 'unknownword' ELSE word END, ' ' ORDER BY i) AS smart FROM ttoks LEFT JOIN w ON word = {normal_sql('value')} GROUP BY conv_id, turn)
SELECT conv_id, turn, regexp_replace(smart, '\\bunknownword( unknownword)+\\b', 'unknownword', 'g') AS smart FROM s"""
)
def smart_noise(spark, sf_dir):
    return sampling.replace_unknown(turn_words(spark, sf_dir), words(spark, sf_dir, 500), TURN_KEYS)


@query(f"SELECT p_partkey, CASE WHEN {_draw(21, 'p_partkey::VARCHAR')} < 0.3 THEN p_name || repeat(' unknownword', (1 + floor({_draw(22, 'p_partkey::VARCHAR')} * 3))::INT) ELSE p_name END AS p_name FROM part")
def unknown_words(spark, sf_dir):
    return sampling.add_unknown(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_partkey"), "p_name", 0.3, 3, 21)


@query("SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5('1:' || doc_id::VARCHAR), doc_id) - 1) % 5 AS fold FROM labels")
def kfold_assign(spark, sf_dir):
    return sampling.folds(table(spark, sf_dir, "labels"), "doc_id", "quality", 5, 1)


_judged = "judged AS (SELECT quality AS actual, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)), m AS (SELECT actual, predicted, count(*) AS n FROM judged GROUP BY 1, 2)"


def matrix(spark, sf_dir):
    """Quality against a rule of length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("predicted"))
    return metrics.confusion(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("actual")).join(docs, "doc_id"))


@query(f"WITH {_judged} SELECT actual, predicted, n FROM m")
def confusion_matrix(spark, sf_dir):
    return matrix(spark, sf_dir)


@query(
    f"""WITH {_judged}, c AS (SELECT actual AS class, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN actual <> predicted THEN n ELSE 0 END AS fn FROM m
UNION ALL SELECT predicted, 0, CASE WHEN actual <> predicted THEN n ELSE 0 END, 0 FROM m), s AS (SELECT class, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ROLLUP (class))
SELECT class, tp AS true_positive, fp AS false_positive, fn AS false_negative, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END::DOUBLE AS precision,
CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END::DOUBLE AS recall, CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END::DOUBLE AS f1 FROM s"""
)
def prf1_rollup(spark, sf_dir):
    scores = metrics.precision_recall(matrix(spark, sf_dir))
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    """WITH raw AS (SELECT vec_id, unnest([0, 1, 2]) AS class, unnest([embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE]) AS d FROM embeddings)
SELECT vec_id, class, round(1 / (1 + exp(-d)), 6) AS probability, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, class) = 1 AS best FROM raw"""
)
def sigmoid_scores(spark, sf_dir):
    raw = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))).alias("class", "d"))
    best = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("d"), "class")) == 1
    return raw.select("vec_id", "class", F.round(1 / (1 + F.exp(-F.col("d"))), 6).alias("probability"), best.alias("best"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def counts_by_day(spark, sf_dir):
    """Events by type in windows of a day, as a stream counts them."""
    counted = counts_by_window(table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "1 hour")
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
