"""Dictionary joins; the dictionaries come from the corpus itself, by rank of frequency."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import lexicon
from parlance.plans.registry import normal_sql, query
from parlance.plans.text_queries import DOC, TURN, TURN_KEYS, doc_words, turn_words
from parlance.session import table

STOPS, COMMON, CLUSTERED, STEMMED = 30, 500, 200, 2000
DOC_TOP = f"""{DOC}, counted AS (SELECT {normal_sql("value")} AS word, count(*) AS n FROM toks GROUP BY 1),
top AS (SELECT row_number() OVER (ORDER BY n DESC, word) AS rank, word FROM counted)"""
#: The conversations' tokens beside the documents' words, under other names.
TURN_TOP = TURN.replace("pieces", "tpieces").replace("ends", "tends").replace("toks", "ttoks") + ", " + DOC_TOP


def words(spark, sf_dir, n):
    return lexicon.top_words(doc_words(spark, sf_dir), n)


def stems(spark, sf_dir):
    """Of frequent words of five letters and more, the stem lacks the last two."""
    long = words(spark, sf_dir, STEMMED).where(F.length("word") > 4)
    return long.select(F.col("word").alias("form"), F.expr("left(word, length(word) - 2)").alias("stem"))


STEM_SQL = f"stems AS (SELECT word AS form, left(word, length(word) - 2) AS stem FROM top WHERE rank <= {STEMMED} AND length(word) > 4)"


@query(f"WITH {DOC_TOP} SELECT rank, word FROM top WHERE rank <= {COMMON}")
def top_words(spark, sf_dir):
    return words(spark, sf_dir, COMMON)


@query(f"WITH {DOC_TOP}, {STEM_SQL} SELECT doc_id, i, coalesce(stem, {normal_sql('value')}) AS stem FROM toks LEFT JOIN stems ON form = {normal_sql('value')}")
def stem_lookup(spark, sf_dir):
    return lexicon.stem(doc_words(spark, sf_dir), stems(spark, sf_dir)).select("doc_id", "i", "stem")


@query(f"WITH {DOC_TOP}, {STEM_SQL} SELECT stem, string_agg(DISTINCT form, ',' ORDER BY form) AS forms FROM stems GROUP BY stem")
def stem_inverse(spark, sf_dir):
    return lexicon.forms_of_stems(stems(spark, sf_dir))


@query(f"WITH {DOC_TOP}, {STEM_SQL}, s AS (SELECT doc_id, i, coalesce(stem, {normal_sql('value')}) AS stem FROM toks LEFT JOIN stems ON form = {normal_sql('value')}) SELECT doc_id, string_agg(stem, ' ' ORDER BY i) AS stemmed FROM s GROUP BY doc_id")
def stem_text(spark, sf_dir):
    stemmed = lexicon.stem(doc_words(spark, sf_dir), stems(spark, sf_dir))
    held = F.array_sort(F.collect_list(F.struct("i", "stem")))
    return stemmed.groupBy("doc_id").agg(F.array_join(F.transform(held, lambda x: x["stem"]), " ").alias("stemmed"))


@query(f"WITH {DOC_TOP} SELECT doc_id, i, CASE WHEN rank <= {COMMON} THEN word ELSE 'rare_word' END AS gated FROM toks JOIN top ON word = {normal_sql('value')}")
def rare_word_gate(spark, sf_dir):
    return lexicon.gate_rare(doc_words(spark, sf_dir), words(spark, sf_dir, COMMON)).select("doc_id", "i", "gated")


@query(f"WITH {DOC_TOP} SELECT doc_id, i, CASE WHEN rank <= {CLUSTERED} THEN 'c' || (rank % 20)::VARCHAR END AS cluster FROM toks JOIN top ON word = {normal_sql('value')}")
def word_cluster(spark, sf_dir):
    clusters = words(spark, sf_dir, CLUSTERED).select("word", F.concat(F.lit("c"), (F.col("rank") % 20).cast("string")).alias("cluster"))
    tokens = doc_words(spark, sf_dir)
    from parlance.functions.text import normalize

    return lexicon.look_up(tokens, clusters, normalize(F.col("value")), "word", "cluster", "cluster").select("doc_id", "i", "cluster")


STOP_SQL = f"stops AS (SELECT word FROM top WHERE rank <= {STOPS})"


@query(
    f"""WITH {TURN_TOP}, {STOP_SQL} SELECT conv_id, turn, lower(coalesce(string_agg(value, ' ' ORDER BY i) FILTER (WHERE word IS NULL), '')) AS kept
FROM ttoks LEFT JOIN stops ON word = {normal_sql('value')} GROUP BY conv_id, turn"""
)
def stopword_filter(spark, sf_dir):
    return lexicon.drop_stop_words(turn_words(spark, sf_dir), TURN_KEYS, words(spark, sf_dir, STOPS))


@query(
    f"""WITH {TURN_TOP}, {STOP_SQL} SELECT conv_id, turn, string_agg(CASE WHEN word IS NULL THEN value ELSE repeat(' ', length(value)) END, '' ORDER BY pos) AS blanked
FROM tpieces LEFT JOIN stops ON word = {normal_sql('value')} GROUP BY conv_id, turn"""
)
def stopword_blank(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return lexicon.blank_stop_words(turns, TURN_KEYS, words(spark, sf_dir, STOPS))


_values = f"vals AS (SELECT DISTINCT lang AS intent, {normal_sql('value')} AS word FROM toks JOIN documents USING (doc_id) WHERE i = 0)"


def first_words(spark, sf_dir):
    """Values of each class: for each language the words that begin a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("intent"))
    return doc_words(spark, sf_dir).where("i = 0").join(docs, "doc_id").select("intent", "value").distinct()


@query(f"WITH {DOC_TOP}, {STOP_SQL}, {_values} SELECT DISTINCT intent, word FROM vals SEMI JOIN stops USING (word)")
def stopword_whitelist(spark, sf_dir):
    return lexicon.whitelist(first_words(spark, sf_dir), words(spark, sf_dir, STOPS))


@query(
    f"""WITH {DOC_TOP}, {STOP_SQL}, {_values}, intents AS (SELECT DISTINCT lang AS intent FROM documents)
SELECT intent, word FROM intents CROSS JOIN stops ANTI JOIN vals USING (intent, word)"""
)
def intent_stopwords(spark, sf_dir):
    stops, intents = words(spark, sf_dir, STOPS), table(spark, sf_dir, "documents").select(F.col("lang").alias("intent")).distinct()
    return lexicon.intent_stop_words(intents, stops, lexicon.whitelist(first_words(spark, sf_dir), stops))
