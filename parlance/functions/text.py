"""Scalar text functions as Column expressions, and tokenisation as a DataFrame operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with an accent and the letters that stand for them after folding.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
#: Characters that are tokens of their own, and the punctuation set shared by all languages.
SYMBOLS = "$%!?&"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

TOKEN = r"[\p{L}\p{N}_]+|[$%!?&]"
#: A placeholder of an entity, as `placeholder` writes it.
MARK = r"%\p{Lu}[\p{Lu}\p{Lo}\p{N}_]*%"
IS_TOKEN = r"^[\p{L}\p{N}_$%!?&]"
PIECE = r"[\p{L}\p{N}_]+|[$%!?&]|[^\p{L}\p{N}_$%!?&]+"


def normalize(text: Column) -> Column:
    """Lower case without accents; ß and œ stay."""
    return F.translate(F.lower(text), ACCENTED, FOLDED)


def tokenize_light(text: Column) -> Column:
    """Token strings: runs of letters, digits and underscores, and each of $ % ! ? & alone."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


#: Pieces whose offsets are summed one by one; sums of such chunks are added up first, so offsets cost a text's length only.
CHUNK = 16


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: as a lambda's variable it is not copied into every place that uses it.

    It is the end of a fold over nothing. An element taken from an array made by f would have Spark work out the type of all of f for every row and, where f is nested, every element.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, f)


def running_sums(values: Column) -> Column:
    """[0, v0, v0 + v1, ...] of an array of integers, one longer than it."""
    running = lambda held: F.aggregate(held, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))

    def of(held: Column) -> Column:
        chunks = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
        local = F.transform(chunks, lambda c: running(F.slice(held, c * CHUNK + 1, F.lit(CHUNK))))
        raised = lambda loc, bases: F.flatten(F.transform(loc, lambda x, c: F.transform(F.slice(x, 2, F.lit(CHUNK)), lambda n: n + F.get(bases, c))))
        return bind(local, lambda loc: bind(running(F.transform(loc, lambda x: F.element_at(x, -1))), lambda bases: F.concat(F.array(F.lit(0)), raised(loc, bases))))

    return bind(values, lambda held: F.when(F.size(held) <= CHUNK, running(held)).otherwise(of(held)))


def numbered(pieces: Column) -> Column:
    """Of an array of pieces, those that are tokens: structs of i, pos (place among the pieces), value, s, e and gap."""

    def of(ends: Column, flags: Column, places: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            gap = F.when(F.coalesce(F.get(flags, p + 1), F.lit(True)), "").otherwise(F.get(pieces, p + 1))
            return F.struct(i.cast("long").alias("i"), p.alias("pos"), F.get(pieces, p).alias("value"), F.get(ends, p).cast("long").alias("s"), F.get(ends, p + 1).cast("long").alias("e"), gap.alias("gap"))

        return F.transform(places, one)

    def flagged(flags: Column) -> Column:
        every = F.when(F.size(flags) > 0, F.sequence(F.lit(0), F.size(flags) - 1)).otherwise(F.array().cast("array<int>"))
        return bind(running_sums(F.transform(pieces, F.length)), lambda ends: bind(F.filter(every, lambda p: F.get(flags, p)), lambda places: of(ends, flags, places)))

    return bind(F.transform(pieces, lambda x: x.rlike(IS_TOKEN)), flagged)


def cut_pieces(text: Column) -> Column:
    """All of a text, cut into tokens and what lies between; a null text has no pieces."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({PIECE})"), F.lit(1)), F.array().cast("array<string>"))


def over_tokens(text: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(pieces, tokens) of a text. pieces: all of it, cut into tokens and what lies between; tokens: structs of i (from 0), pos (place
    among the pieces), value, its half-open range s, e in code points, and gap (what stands between it and the next token, empty for nothing).

    All of it happens within the row, so it needs neither a shuffle nor a key that tells rows apart. A null text has none.
    """
    return bind(cut_pieces(text), lambda p: bind(numbered(p), lambda t: f(p, t)))


def token_array(text: Column) -> Column:
    """The tokens that `over_tokens` gives, as an array."""
    return over_tokens(text, lambda _, toks: toks)


def covered(pieces: Column, first: Column, last: Column) -> Column:
    """The part of the text from one token to another, both included."""
    return F.array_join(F.slice(pieces, first["pos"] + 1, last["pos"] - first["pos"] + 1), "")


def join_shifts(toks: Column) -> Column:
    """Structs i, shift: how far each token lies from where it would lie were tokens joined by single spaces."""
    gaps = F.transform(toks, lambda t, i: (t["s"] - F.coalesce(F.get(toks, i - 1)["e"], F.lit(0)) - F.when(i > 0, 1).otherwise(0)).cast("int"))
    return bind(running_sums(gaps), lambda sums: F.transform(toks, lambda t, i: F.struct(t["i"].alias("i"), F.get(sums, i + 1).cast("long").alias("shift"))))


def each(df: DataFrame, keys: list[str], array: Column, name: str) -> DataFrame:
    """keys and a row for each element of an array, which has no null elements; none for an empty or null array.

    Of a plain explode Spark makes a filter of rows whose array has elements as well, and computes the array for it once more; so the outer form is used, and its null row for an empty array is taken away.
    """
    return df.select(*keys, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per token: keys, i (from 0), value and its half-open range s, e in code points.

    A map without shuffle: rows with equal or null keys each give their own tokens; a null text has none.
    """
    return each(df, keys, token_array(F.col(text)), "t").select(*keys, "t.i", "t.value", "t.s", "t.e")


def words(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per token: keys, i (from 0) and value, as `tokens` gives them, without their places in the text, which cost several times as much as cutting it. A map without shuffle; a null text has none."""
    return df.select(*keys, F.posexplode_outer(tokenize_light(F.col(text))).alias("i", "value")).where(F.col("value").isNotNull()).withColumn("i", F.col("i").cast("long"))


def per_token(df: DataFrame, keys: list[str], f: Callable[[Column, Column, Column], list[Column]], text: str = "text") -> DataFrame:
    """keys, i and named columns for each token, made by f(tokens, token, i), which may look at neighbours. A map without shuffle."""
    rows = over_tokens(F.col(text), lambda _, toks: F.transform(toks, lambda t, i: F.struct(t["i"].alias("i"), *f(toks, t, i))))
    return each(df, keys, rows, "t").select(*keys, "t.*")


def shape(token: Column) -> Column:
    """xxx, XXX, Xxx or xX by the case of the letters."""
    return (
        F.when(token == F.lower(token), "xxx")
        .when(token == F.upper(token), "XXX")
        .when((F.substring(token, 1, 1) == F.upper(F.substring(token, 1, 1))) & (F.substring(token, 2, 1 << 30) == F.lower(F.substring(token, 2, 1 << 30))), "Xxx")
        .otherwise("xX")
    )


def prefix(token: Column, k: int) -> Column:
    """The first k characters; null for a shorter token."""
    if k < 1:
        raise ValueError("the size must be positive")
    return F.when(F.length(token) >= k, F.substring(token, 1, k))


def suffix(token: Column, k: int) -> Column:
    """The last k characters; null for a shorter token."""
    if k < 1:
        raise ValueError("the size must be positive")
    return F.when(F.length(token) >= k, F.right(token, F.lit(k)))


def is_digit(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{Nd}+$"), "1")


def title(text: Column) -> Column:
    """Every run of letters with a capital first and small letters after it."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def title_but(text: Column, stops: list[str]) -> Column:
    """Each token with a capital first, but for stop words; what lies between tokens stays."""
    pieces = F.regexp_extract_all(text, F.lit(f"({PIECE})"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(normalize(p).isin(*stops), p).otherwise(title(p)) if stops else title(p)), "")


def key_hash(text: Column) -> Column:
    """A text as a whole number, for keys that are only compared."""
    return F.xxhash64(text)


def separator(language: str) -> str:
    """What stands between tokens that are joined: nothing in languages that are written without spaces."""
    return "" if language in ("ja", "zh", "th") else " "


def is_title(token: Column) -> Column:
    """Whether the token has a letter and is written as `title` writes it."""
    return token.rlike(r"\p{L}") & (token == title(token))


def is_upper(token: Column) -> Column:
    return token.rlike(r"\p{L}") & (token == F.upper(token)) & (token != F.lower(token))


def ngrams(token_array: Column, longest: int) -> Column:
    """All contiguous n-grams of up to `longest` tokens as structs (i, n, ngram)."""

    def grams(held: Column) -> Column:
        n = F.size(held)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        own = lambda i, k: F.struct(i.alias("i"), k.alias("n"), F.array_join(F.slice(held, i + 1, k), " ").alias("ngram"))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i)), lambda k: own(i, k))))

    return bind(token_array, grams)


def regex_escape(text: Column) -> Column:
    """A text with the metacharacters of regular expressions escaped."""
    return F.regexp_replace(text, r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\$1")


def placeholder(entity: Column) -> Column:
    """%TOKENS% for an entity name, in capitals without separators."""
    return F.concat(F.lit("%"), F.upper(F.array_join(tokenize_light(entity), "")), F.lit("%"))


def feature_name(entity: Column, builtin: bool) -> Column:
    return F.concat(F.lit("builtinentityfeature" if builtin else "entityfeature"), F.lower(F.array_join(tokenize_light(entity), "")))


def encode_tag(tag: Column) -> Column:
    return F.base64(F.encode(tag, "utf-8"))


def decode_tag(tag: Column) -> Column:
    return F.decode(F.unbase64(tag), "utf-8")


def version_parts(version: Column) -> Column:
    """major, minor, patch, subpatch, prerelease and build of a version; null where absent, null struct if it is none."""
    form = r"^(\d+)\.(\d+)\.(\d+)(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"
    part = lambda i: F.nullif(F.regexp_extract(version, form, i), F.lit(""))
    names = ["major", "minor", "patch", "subpatch"]
    return F.when(version.rlike(form), F.struct(*[part(i + 1).cast("long").alias(n) for i, n in enumerate(names)], part(5).alias("prerelease"), part(6).alias("build")))


def digit_value(number: Column) -> Column:
    """A number in digits, whole ones without a fraction."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def unit_name(name: Column) -> Column:
    """A unit name that can serve as a folder name."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[ /\\]", "")
