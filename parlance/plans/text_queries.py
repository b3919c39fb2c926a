"""Tokens, token features and scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import numbers, text
from parlance.plans.registry import normal_sql, query, tokens_sql
from parlance.session import table

DOC = tokens_sql("documents", "doc_id")
TURN = tokens_sql("conversations", "conv_id, turn")
TURN_KEYS = ["conv_id", "turn"]


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tokens(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), TURN_KEYS)


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens without their offsets, for what only counts them or looks them up."""
    return text.words(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.words(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), TURN_KEYS)


@query(f"WITH {DOC} SELECT doc_id, i, value, s, e FROM toks")
def tok_offsets(spark, sf_dir):
    return doc_tokens(spark, sf_dir)


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[$%!?&]'))::BIGINT AS n_tokens FROM conversations")
def tok_light_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.tokenize_light(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, {normal_sql('text')} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


SHAPE_SQL = "CASE WHEN value = lower(value) THEN 'xxx' WHEN value = upper(value) THEN 'XXX' WHEN substr(value, 1, 1) = upper(substr(value, 1, 1)) AND substr(value, 2) = lower(substr(value, 2)) THEN 'Xxx' ELSE 'xX' END"


@query(f"WITH {TURN} SELECT conv_id, turn, i, {SHAPE_SQL} AS shape FROM toks")
def token_shape(spark, sf_dir):
    return turn_words(spark, sf_dir).select(*TURN_KEYS, "i", text.shape(F.col("value")).alias("shape"))


_affix = ", ".join(f"CASE WHEN length(v) >= {k} THEN left(v, {k}) END AS prefix_{k}, CASE WHEN length(v) >= {k} THEN right(v, {k}) END AS suffix_{k}" for k in (1, 2, 3))


@query(f"WITH {TURN}, norm AS (SELECT *, {normal_sql('value')} AS v FROM toks) SELECT conv_id, turn, i, {_affix} FROM norm")
def prefix_suffix(spark, sf_dir):
    norm = text.normalize(F.col("value"))
    out = [f(norm, k).alias(f"{name}_{k}") for k in (1, 2, 3) for name, f in (("prefix", text.prefix), ("suffix", text.suffix))]
    return turn_words(spark, sf_dir).select(*TURN_KEYS, "i", *out)


@query(f"WITH {DOC} SELECT doc_id, i, length(value)::VARCHAR AS length, CASE WHEN regexp_matches(value, '^\\p{{Nd}}+$') THEN '1' END AS is_digit FROM toks")
def token_length_digit(spark, sf_dir):
    return doc_words(spark, sf_dir).select("doc_id", "i", F.length("value").cast("string").alias("length"), text.is_digit(F.col("value")).alias("is_digit"))


def turn_features(spark, sf_dir, f):
    """Columns made of each token and its neighbours, in the conversations' turns."""
    return text.per_token(table(spark, sf_dir, "conversations"), TURN_KEYS, f)


def _gram_of(of, n):
    """The n tokens from one on, or null where there are fewer."""

    def f(toks, t, i):
        return F.when(i + n <= F.size(toks), F.array_join(F.transform(F.slice(toks, i + 1, F.lit(n)), lambda x: of(x["value"])), " "))

    return f


_gram = lambda v, n: f"CASE WHEN count(*) OVER w{n} = {n} THEN string_agg({v}, ' ') OVER w{n} END"
_gram_windows = ", ".join(f"w{n} AS (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in (2, 3))


@query(f"WITH {TURN} SELECT conv_id, turn, i, {_gram('lower(value)', 2)} AS ngram_2, {_gram('lower(value)', 3)} AS ngram_3 FROM toks WINDOW {_gram_windows}")
def ngram_forward(spark, sf_dir):
    return turn_features(spark, sf_dir, lambda *a: [_gram_of(F.lower, n)(*a).alias(f"ngram_{n}") for n in (2, 3)])


@query(f"WITH {TURN}, shapes AS (SELECT *, {SHAPE_SQL} AS shape FROM toks) SELECT conv_id, turn, i, {_gram('shape', 2)} AS shape_2, {_gram('shape', 3)} AS shape_3 FROM shapes WINDOW {_gram_windows}")
def shape_ngram(spark, sf_dir):
    return turn_features(spark, sf_dir, lambda *a: [_gram_of(text.shape, n)(*a).alias(f"shape_{n}") for n in (2, 3)])


@query(
    """WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[$%!?&]') AS a FROM conversations),
s AS (SELECT *, unnest(range(len(a))) AS i FROM t), g AS (SELECT *, unnest(range(1, least(4, len(a) - i) + 1)) AS n FROM s)
SELECT conv_id, turn, i, n, array_to_string(a[i + 1 : i + n], ' ') AS ngram FROM g"""
)
def all_ngrams(spark, sf_dir):
    grams = text.ngrams(text.tokenize_light(F.col("text")), 4)
    out = text.each(table(spark, sf_dir, "conversations"), TURN_KEYS, grams, "g")
    return out.select(*TURN_KEYS, F.col("g.i").cast("long").alias("i"), F.col("g.n").cast("long").alias("n"), "g.ngram")


@query(
    f"""WITH {TURN} SELECT conv_id, turn, i, i = 0 AS is_first, i = max(i) OVER (PARTITION BY conv_id, turn) AS is_last,
lag(value) OVER w AS "value[-1]", lead(value) OVER w AS "value[+1]", lead(value, 2) OVER w AS "value[+2]" FROM toks WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)"""
)
def offset_features(spark, sf_dir):
    value = lambda toks, i, k: F.get(toks, i + k)["value"].alias(f"value[{k:+d}]")
    return turn_features(spark, sf_dir, lambda toks, t, i: [(i == 0).alias("is_first"), (i == F.size(toks) - 1).alias("is_last"), *[value(toks, i, k) for k in (-1, 1, 2)]])


@query(
    f"""WITH {DOC} SELECT doc_id, bool_or(regexp_matches(value, '\\p{{L}}') AND ((value = upper(value) AND value <> lower(value)) OR
 value = list_reduce(list_prepend('', list_transform(regexp_extract_all(value, '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2)))), lambda a, b: a || b))) AS capitalize
FROM toks GROUP BY doc_id"""
)
def capitalize_flag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokenize_light(F.col("text")).alias("toks")).where(F.size("toks") > 0)
    return docs.select("doc_id", F.exists("toks", lambda v: text.is_upper(v) | text.is_title(v)).alias("capitalize"))


@query(
    f"""WITH {TURN}, shifted AS (SELECT *, (s - coalesce(sum(length(value) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS shift FROM toks)
SELECT conv_id, turn, i, shift FROM shifted"""
)
def char_shifts(spark, sf_dir):
    """How far each token lies from where it would lie were tokens joined by single spaces."""
    turns = table(spark, sf_dir, "conversations").select(*TURN_KEYS, text.token_array(F.col("text")).alias("toks"))
    return text.each(turns, TURN_KEYS, text.join_shifts(F.col("toks")), "x").select(*TURN_KEYS, "x.i", "x.shift")


@query(
    f"""WITH {TURN}, gaps AS (SELECT *, s - coalesce(lag(e) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) AS gap FROM toks)
SELECT conv_id, turn, string_agg(repeat(' ', gap::BIGINT) || value, '' ORDER BY i) AS rebuilt FROM gaps GROUP BY conv_id, turn"""
)
def initial_string(spark, sf_dir):
    """The text rebuilt from its tokens, gaps filled with spaces."""
    spaced = lambda toks: F.transform(toks, lambda t, i: F.concat(F.repeat(F.lit(" "), (t["s"] - F.coalesce(F.get(toks, i - 1)["e"], F.lit(0))).cast("int")), t["value"]))
    turns = table(spark, sf_dir, "conversations").select(*TURN_KEYS, text.over_tokens(F.col("text"), lambda _, toks: spaced(toks)).alias("parts"))
    return turns.where(F.size("parts") > 0).select(*TURN_KEYS, F.array_join("parts", "").alias("rebuilt"))


_esc = r"regexp_replace(p_brand, '([\\.+*?()|\[\]{}^$#&\-~])', '\\\1', 'g')"


@query(
    f"""SELECT p_partkey, {_esc} AS escaped, '%' || upper(array_to_string(regexp_extract_all(p_name, '[\\p{{L}}\\p{{N}}_]+|[$%!?&]'), '')) || '%' AS placeholder,
'entityfeature' || lower(array_to_string(regexp_extract_all(p_name, '[\\p{{L}}\\p{{N}}_]+|[$%!?&]'), '')) AS feature,
'builtinentityfeature' || lower(array_to_string(regexp_extract_all(p_type, '[\\p{{L}}\\p{{N}}_]+|[$%!?&]'), '')) AS builtin_feature,
regexp_replace(lower(trim(p_name)), '[ /]', '', 'g') AS unit_name FROM part"""
)
def name_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.regex_escape(F.col("p_brand")).alias("escaped"), text.placeholder(F.col("p_name")).alias("placeholder"),
        text.feature_name(F.col("p_name"), False).alias("feature"), text.feature_name(F.col("p_type"), True).alias("builtin_feature"), text.unit_name(F.col("p_name")).alias("unit_name"),
    )


@query("SELECT p_partkey, base64(encode(p_name)) AS encoded, p_name AS decoded FROM part")
def tag_codec(spark, sf_dir):
    coded = table(spark, sf_dir, "part").select("p_partkey", text.encode_tag(F.col("p_name")).alias("encoded"))
    return coded.withColumn("decoded", text.decode_tag(F.col("encoded")))


@query(
    """SELECT p_partkey, (p_size)::BIGINT AS major, (p_partkey % 10)::BIGINT AS minor, (p_partkey % 7)::BIGINT AS patch, CASE WHEN p_partkey % 3 = 0 THEN 1::BIGINT END AS subpatch,
CASE WHEN p_partkey % 5 = 0 THEN 'rc.1' END AS prerelease, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS build FROM part"""
)
def version_parse(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    maybe = lambda c, v: F.when(c, v).otherwise("")
    k = F.col("p_partkey")
    version = F.concat(F.concat_ws(".", F.col("p_size").cast("string"), (k % 10).cast("string"), (k % 7).cast("string")), maybe(k % 3 == 0, F.lit(".1")), maybe(k % 5 == 0, F.lit("-rc.1")), maybe(k % 2 == 0, F.concat(F.lit("+"), "p_type")))
    return p.select("p_partkey", text.version_parts(version).alias("v")).select("p_partkey", "v.*")


@query("SELECT p_partkey, lower(p_name) AS small, list_reduce(list_prepend('', list_transform(regexp_extract_all(p_name, '\\p{L}+|[^\\p{L}]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2)))), lambda a, b: a || b) AS titled FROM part")
def case_variations(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("small"), text.title(F.col("p_name")).alias("titled"))


@query(
    """SELECT p_partkey, list_reduce(list_prepend('', list_transform(regexp_extract_all(lower(p_type || ' of ' || p_name || ' and the rest'), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'),
  lambda w: CASE WHEN w IN ('of', 'and', 'the') THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END)), lambda a, b: a || b) AS shown FROM part"""
)
def title_but_stop_words(spark, sf_dir):
    said = F.lower(F.concat("p_type", F.lit(" of "), "p_name", F.lit(" and the rest")))
    return table(spark, sf_dir, "part").select("p_partkey", text.title_but(said, ["of", "and", "the"]).alias("shown"))


#: Number words put together in SQL itself.
WORDS_SQL = """(CASE WHEN n < 20 THEN ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'][n + 1]
ELSE ['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'][n // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || ['one','two','three','four','five','six','seven','eight','nine'][n % 10] ELSE '' END END)"""


@query(f"WITH w AS (SELECT n, {WORDS_SQL} AS words FROM range(100) r(n)) SELECT p_partkey, words AS size_words, CASE WHEN p_retailprice = floor(p_retailprice) THEN floor(p_retailprice)::BIGINT::VARCHAR END AS whole_price FROM part JOIN w ON n = p_size")
def number_values(spark, sf_dir):
    price = F.col("p_retailprice")
    whole = F.when(price == F.floor(price), text.digit_value(price))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.word_column(F.col("p_size")).alias("size_words"), whole.alias("whole_price"))
