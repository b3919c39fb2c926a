"""Numbers in words, in English, German, French and Spanish: spelled from whole numbers below 10 ** 9, and read back from texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import text


def _w(words: str) -> tuple[str, ...]:
    return tuple(words.split())


#: The words of each language, in ascending order.
EN_SMALL = _w("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen")
EN_TENS = _w("twenty thirty forty fifty sixty seventy eighty ninety")
EN_ORDINALS = _w("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth")
EN_TENTHS = _w("twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth")
DE_SMALL = _w("null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn")
DE_TENS = _w("zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig")
DE_ORDINALS = _w("erst zweit dritt viert fünft sechst siebt acht neunt zehnt elft zwölft dreizehnt vierzehnt fünfzehnt sechzehnt siebzehnt achtzehnt neunzehnt")
FR_SMALL = _w("zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf")
FR_TENS = _w("vingt trente quarante cinquante soixante")
FR_ORDINALS = _w("premier deuxième troisième quatrième cinquième sixième septième huitième neuvième dixième onzième douzième treizième quatorzième quinzième seizième")
ES_SMALL = _w("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve")
ES_TENS = _w("treinta cuarenta cincuenta sesenta setenta ochenta noventa")
ES_HUNDREDS = _w("ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos")
ES_ORDINALS = _w("primero segundo tercero cuarto quinto sexto séptimo octavo noveno décimo")

LANGUAGES = ("en", "de", "fr", "es")
#: Numbers from here on are not spelled.
TOO_LARGE = 10**9


# spelling: words of the numbers below a thousand by rule, and of these the larger ones


def group_words(n: int, lang: str) -> str:
    """A number from 0 to 999 as it stands alone or at the end."""
    low, unit = n % 100, n % 10
    if n >= 100:
        rest = group_words(low, lang) if low else ""
        if lang == "en":
            return f"{EN_SMALL[n // 100]} hundred" + (f" and {rest}" if rest else "")
        if lang == "de":
            return ("ein" if n < 200 else DE_SMALL[n // 100]) + "hundert" + rest
        if lang == "fr":
            return ("cent" if n < 200 else f"{FR_SMALL[n // 100]} cent" + ("" if rest else "s")) + (f" {rest}" if rest else "")
        return "cien" if n == 100 else ES_HUNDREDS[n // 100 - 1] + (f" {rest}" if rest else "")
    if lang == "en":
        return EN_SMALL[n] if n < 20 else EN_TENS[n // 10 - 2] + (f"-{EN_SMALL[unit]}" if unit else "")
    if lang == "de":
        return DE_SMALL[n] if n < 20 else (("ein" if unit == 1 else DE_SMALL[unit]) + "und" if unit else "") + DE_TENS[n // 10 - 2]
    if lang == "es":
        return ES_SMALL[n] if n < 30 else ES_TENS[n // 10 - 3] + (f" y {ES_SMALL[unit]}" if unit else "")
    if n < 20:
        return FR_SMALL[n]
    if n < 70:
        return FR_TENS[n // 10 - 2] + ("" if not unit else " et un" if unit == 1 else f"-{FR_SMALL[unit]}")
    if n < 80:
        return "soixante et onze" if n == 71 else f"soixante-{FR_SMALL[n - 60]}"
    return "quatre-vingts" if n == 80 else f"quatre-vingt-{FR_SMALL[n - 80]}"


def scale_words(n: int, lang: str, million: bool) -> str:
    """So many thousands or millions, for n from 1 to 999."""
    said = group_words(n, lang)
    if lang == "en":
        return f"{said} million" if million else f"{said} thousand"
    if lang == "de":
        if million:
            return "eine Million" if n == 1 else (said[:-1] + "e" if n % 100 == 1 else said) + " Millionen"
        return (said[:-1] if n % 100 == 1 else said) + "tausend"
    if lang == "fr":
        if million:
            return "un million" if n == 1 else f"{said} millions"
        return "mille" if n == 1 else said.removesuffix("s" if n % 100 in (0, 80) else "") + " mille"
    if n == 1:
        return "un millón" if million else "mil"
    said = said[:-3] + "ún" if n % 100 == 21 else said[:-1] if said.endswith("uno") else said
    return f"{said} millones" if million else f"{said} mil"


def _lists(lang: str) -> list[str]:
    """Millions, thousands and units of 0 to 999, each joined by bars; none of nothing."""
    each = lambda f: "|".join(f(n) if n else "" for n in range(1000))
    return [each(lambda n: scale_words(n, lang, True)), each(lambda n: scale_words(n, lang, False)), each(lambda n: group_words(n, lang))]


ZERO = {"en": EN_SMALL[0], "de": DE_SMALL[0], "fr": FR_SMALL[0], "es": ES_SMALL[0]}


def spell(n: Column, lang: str) -> Column:
    """A whole number in words; null below 0, from TOO_LARGE on, and in languages that have no words here. In English and stands before what is below a hundred, a comma before more."""
    if lang not in LANGUAGES:
        return F.lit(None).cast("string")
    millions, thousands, units = (F.split(F.lit(words), r"\|") for words in _lists(lang))

    def said(n: Column) -> Column:
        m, t, r = F.floor(n / 10**6), F.floor(n / 1000) % 1000, n % 1000
        gap = lambda low: F.when(low < 100, " and ").otherwise(", ") if lang == "en" else F.lit(" ")
        one, two = F.when((m > 0) & (n % 10**6 > 0), gap(n % 10**6)).otherwise(""), F.when((t > 0) & (r > 0), F.lit("") if lang == "de" else gap(r)).otherwise("")
        words = F.concat(F.get(millions, m.cast("int")), one, F.get(thousands, t.cast("int")), two, F.get(units, r.cast("int")))
        return F.when(n == 0, ZERO[lang]).when((n > 0) & (n < TOO_LARGE), words)

    return text.bind(n.cast("long"), said)


def spelled_sql(n: str, lang: str) -> str:
    """The same as an SQL expression for DuckDB, of a column n."""
    of = lambda words, at: f"string_split('{words}', '|')[({at}) + 1]"
    millions, thousands, units = _lists(lang)
    m, t, r, low = f"{n} // 1000000", f"{n} // 1000 % 1000", f"{n} % 1000", f"{n} % 1000000"
    gap = lambda x: f"CASE WHEN {x} < 100 THEN ' and ' ELSE ', ' END" if lang == "en" else "' '"
    one, two = f"CASE WHEN {m} > 0 AND {low} > 0 THEN {gap(low)} ELSE '' END", "''" if lang == "de" else f"CASE WHEN {t} > 0 AND {r} > 0 THEN {gap(r)} ELSE '' END"
    return f"(CASE WHEN {n} = 0 THEN '{ZERO[lang]}' WHEN {n} > 0 AND {n} < {TOO_LARGE} THEN {of(millions, m)} || {one} || {of(thousands, t)} || {two} || {of(units, r)} END)"


# reading: a pattern of whole phrases, and a sum over their words


@dataclass(frozen=True)
class Reader:
    """pattern: a phrase, without case; values: what a word of it adds, multiplies or scales by; ordinals: those of the words that make the phrase an ordinal; mark: what follows its digits."""

    pattern: str
    values: dict[str, int]
    ordinals: tuple[str, ...]
    mark: str


def _any(words) -> str:
    return "(?:" + "|".join(sorted((re.escape(w).replace(r"\-", "-") for w in words), key=len, reverse=True)) + ")"


def _number(words: tuple[str, ...], first: int = 0) -> dict[str, int]:
    return {w: i for i, w in enumerate(words, first)}


def _tens(words: tuple[str, ...], first: int = 2) -> dict[str, int]:
    return {w: 10 * i for i, w in enumerate(words, first)}


def _english() -> Reader:
    unit, teen, ten = _any(EN_SMALL[1:10]), _any((*EN_SMALL[10:], "zero")), _any(EN_TENS)
    scale = _w("hundred thousand million billion")
    low = rf"(?:{ten}\b(?:[\s-]+{unit}\b)?|{teen}\b|{unit}\b)"
    group = rf"(?:(?:a(?=\s+hundred)|{low})\s+hundred\b(?:\s+(?:and\s+)?{low})?|a(?=\s+(?:thousand|million|billion)\b)|{low})"
    join = r"(?:\s*,\s+|\s+(?:and\s+)?)"
    number = group + "".join(rf"(?:\s+{s}\b(?:{join}{group})?)?" for s in ("billion", "million", "thousand"))
    tenths, last = dict(zip(EN_TENTHS, range(20, 100, 10))), {f"{s}th": v for s, v in zip(scale, (100, 10**3, 10**6, 10**9))}
    ordinals = {w: i for i, w in enumerate(EN_ORDINALS, 1)} | tenths | last
    # "second" is a unit of time unless a determiner or ten stands before it
    plain = [w for w in ordinals if w not in last and w != "second"]
    alone = rf"(?:{_any(plain)}|(?<=\b(?:the|my|our|this|every)\s)second(?!\s+(?:of|before|after)\b))\b"
    ordinal = rf"(?:{number}(?<=hundred|thousand|million|billion)\s+(?:and\s+)?)?(?:{ten}[\s-]+{_any(EN_ORDINALS[:9])}\b|{alone})|{number}\s+{_any(last)}\b"
    values = _number(EN_SMALL) | _tens(EN_TENS) | dict(zip(scale, (100, 10**3, 10**6, 10**9))) | ordinals | {"a": 1}
    return Reader(f"{ordinal}|{number}", values, tuple(ordinals), "th")


def _german() -> Reader:
    stems = {w: i for i, w in enumerate(DE_SMALL[2:10], 2)} | {"ein": 1, "zwo": 2}
    tens = _tens(DE_TENS) | {"dreissig": 30}
    unit = _any(stems)
    low = rf"(?:{unit}und{_any(tens)}|{_any(DE_SMALL[10:])}|{_any(tens)}|eins|null|{unit})"
    group = rf"(?:(?:{unit}|(?=hundert))hundert(?:und)?{low}?|{low})"
    million = rf"(?:eine(?=\s+mill)|{group}e?)\s+(?:milliarden?)(?:\s+{group})?(?:\s+millionen)?|(?:eine(?=\s+mill)|{group}e?)\s+million(?:en)?"
    number = rf"(?:(?:{million})\s+)?(?:{group}|(?=tausend))tausend(?:\s*(?:und)?{group})?|(?:{million})(?:\s+{group})?|{group}"
    first = {f"{w}e": i for i, w in enumerate(DE_ORDINALS, 1)}
    ordinal = rf"(?:(?:{unit}?(?:hundert|tausend)(?:und)?)?{_any(first)}|(?:{number})ste)[rnsm]?"
    values = _number(DE_SMALL) | stems | tens | {"eine": 1, "hundert": 100, "tausend": 1000, "million": 10**6, "millionen": 10**6, "milliarde": 10**9, "milliarden": 10**9} | first | {"ste": 0}
    # an article is a number only before a unit of something
    articles = r"(?!ein(?!\s+(?:tag|jahr|monat|grad|prozent|euro)\b)(?![\p{L}]))"
    article = r"(?:eine|einen|einem|einer)(?=\s+(?:sekunde|minute|stunde|tag|woche|monat|jahr)\b)"
    return Reader(f"{ordinal}|{articles}(?:{number})|{article}", values | {"einen": 1, "einem": 1, "einer": 1}, (*first, "ste"), "te")


def _french() -> Reader:
    unit = _any((*FR_SMALL[1:10], "une"))
    teen = rf"(?:dix[\s-](?:sept|huit|neuf)|{_any(FR_SMALL[10:17])})"
    low = rf"(?:quatre[\s-]vingts?\b(?:[\s-](?:{teen}|{unit})\b)?|soixante\b(?:(?:\s+et)?[\s-]+(?:{teen}|{unit})\b)?|{_any(FR_TENS[:4])}\b(?:(?:\s+et)?[\s-]+{unit}\b)?|{teen}\b|zéro|{unit}\b)"
    group = rf"(?:(?:{unit}\s+)?cents?\b(?:\s+{low})?|{low})"
    number = rf"(?:{group}\s+millions?\b(?:\s+(?:{group}\s+)?mille\b(?:\s+{group})?|\s+{group})?|(?:{group}\s+)?mille\b(?:\s+{group})?|{group})"
    ordinals = {w: i for i, w in enumerate(FR_ORDINALS, 1)} | {"première": 1, "unième": 1} | dict(zip(("vingtième", "trentième", "quarantième", "cinquantième", "soixantième"), range(20, 70, 10)))
    ordinal = rf"(?:(?:{_any(FR_TENS)}|quatre[\s-]vingt)(?:\s+et)?[\s-]+)?{_any(ordinals)}"
    values = _number(FR_SMALL[:17]) | _tens(FR_TENS) | {"une": 1, "vingts": 20, "cent": 100, "cents": 100, "mille": 1000, "million": 10**6, "millions": 10**6} | ordinals
    articles = r"(?!une?\b(?!\s+(?:seconde|minute|heure|jour|semaine|mois|an|année|degré|euro|million)))"
    return Reader(f"{ordinal}|{articles}{number}", values, tuple(ordinals), "e")


def _spanish() -> Reader:
    small = _number(ES_SMALL) | {"un": 1, "una": 1, "veintiún": 21, "veintiuna": 21, "dieciseis": 16, "veintidos": 22, "veintitres": 23, "veintiseis": 26}
    tens, hundreds = _tens(ES_TENS, 3), {w: 100 * i for i, w in enumerate(ES_HUNDREDS, 1)} | {"cien": 100}
    hundreds |= {w[:-2] + "as": v for w, v in hundreds.items() if w.endswith("os")}
    low = rf"(?:{_any(tens)}\b(?:\s+y\s+{_any([w for w, v in small.items() if 0 < v < 10])}\b)?|{_any(small)}\b)"
    group = rf"(?:{_any(hundreds)}\b(?:\s+{low})?|{low})"
    number = rf"(?:{group}\s+mill(?:ón|on|ones)\b(?:\s+(?:{group}\s+)?mil\b(?:\s+{group})?|\s+{group})?|(?:{group}\s+)?mil\b(?:\s+{group})?|{group})"
    stems = [w[:-1] for w in ES_ORDINALS]
    ordinals = {s + end: i for i, s in enumerate(stems, 1) for end in ("o", "a")} | {"primer": 1, "tercer": 3}
    # segundo and cuarto are also a unit of time and a room
    alone = rf"(?:{_any([w for w in ordinals if w not in ('segundo', 'cuarto')])}|(?<=\b(?:el|al)\s)segundo)"
    values = small | tens | hundreds | {"mil": 1000, "millón": 10**6, "millon": 10**6, "millones": 10**6} | ordinals
    articles = r"(?!una?\b(?!\s+(?:segundo|minuto|hora|día|semana|mes|año|grado|mill[óo]n)))"
    return Reader(f"{alone}|{articles}{number}", values, tuple(ordinals), "o")


READERS = {"en": _english(), "de": _german(), "fr": _french(), "es": _spanish()}
EDGE_BEFORE, EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def phrase_pattern(lang: str) -> str:
    """The regular expression of a number in words, with what it may not touch. A word that begins unlike all number words costs one look at its first two letters."""
    seconds: dict[str, set[str]] = {}
    for w in READERS[lang].values:
        seconds.setdefault(w[0], set()).add(w[1] if len(w) > 1 else r"\s")
    begins = "|".join(f"{a}[{''.join(sorted(b))}]" for a, b in sorted(seconds.items()))
    return f"(?iuU){EDGE_BEFORE}(?={begins})(?:{READERS[lang].pattern}){EDGE_AFTER}"


#: Stands for a number where a text is cut at its numbers: Spark compiles the pattern of a split for each row, but that of a replacement once.
CUT = "\ue000"


def digits(phrase: Column, lang: str) -> Column:
    """A phrase in digits; an ordinal has its mark behind. Small words add up, a hundred multiplies its group, a thousand and more close it. In French, vingt after quatre makes eighty."""
    reader = READERS[lang]
    edge = "" if lang == "de" else r"\b"
    words = F.regexp_extract_all(F.lower(phrase), F.lit(f"(?U){edge}({_any(reader.values)}){edge}"), F.lit(1))
    known = F.create_map(*[F.lit(x) for pair in reader.values.items() for x in pair])

    def fold(words: Column) -> Column:
        zero = F.lit(0).cast("long")
        start = F.struct(zero.alias("total"), zero.alias("group"), zero.alias("last"))

        def add(acc: Column, word: Column) -> Column:
            def one(v: Column) -> Column:
                group = F.when(v >= 1000, 0).when(v == 100, F.lit(100) if lang == "es" else F.greatest(acc["group"], F.lit(1)) * 100)
                if lang == "fr":
                    group = group.when((v == 20) & (acc["last"] == 4), acc["group"] + 76)
                if lang == "es":
                    group = F.when(v >= 1000, 0)
                group = group.otherwise(acc["group"] + v)
                return F.struct((acc["total"] + F.when(v >= 1000, F.greatest(acc["group"], F.lit(1)) * v).otherwise(0)).cast("long").alias("total"), group.cast("long").alias("group"), v.alias("last"))

            return text.bind(F.coalesce(F.try_element_at(known, word), F.lit(0)).cast("long"), one)

        value = F.aggregate(words, start, add, lambda acc: acc["total"] + acc["group"])
        return F.concat(value.cast("string"), F.when(F.element_at(words, -1).isin(*reader.ordinals), reader.mark).otherwise(""))

    return text.bind(words, fold)


SEGMENTS = "array<struct<os:int,oe:int,ns:int,ne:int>>"


def in_digits(source: Column, lang: str) -> Column:
    """Struct of text (the source with its numbers in digits) and segments: where each number stood (os, oe) and stands (ns, ne). Within the row, by one regular expression;
    a text without number words stays as it is. Null for a null text."""
    pattern = phrase_pattern(lang)

    def written(phrases: Column, between: Column) -> Column:
        def of(numbers: Column) -> Column:
            def sums(old: Column, new: Column) -> Column:
                places = F.transform(phrases, lambda p, i: F.struct(
                    (F.get(old, i + 1) - F.length(p)).alias("os"), F.get(old, i + 1).alias("oe"), (F.get(new, i + 1) - F.length(F.get(numbers, i))).alias("ns"), F.get(new, i + 1).alias("ne")))
                joined = F.concat(F.array_join(F.transform(numbers, lambda d, i: F.concat(F.get(between, i), d)), ""), F.element_at(between, -1))
                return F.struct(joined.alias("text"), places.cast(SEGMENTS).alias("segments"))

            lengths = lambda with_: text.running_sums(F.transform(with_, lambda p, i: (F.length(F.get(between, i)) + F.length(p)).cast("int")))
            return text.bind(lengths(phrases), lambda old: text.bind(lengths(numbers), lambda new: sums(old, new)))

        return text.bind(F.transform(phrases, lambda p: digits(p, lang)), of)

    same = F.struct(source.alias("text"), F.array().cast(SEGMENTS).alias("segments"))
    found = lambda phrases: F.when(F.size(phrases) > 0, text.bind(F.split(F.regexp_replace(F.translate(source, CUT, "\ue001"), pattern, CUT), CUT, -1), lambda between: written(phrases, between))).otherwise(same)
    return text.bind(F.regexp_extract_all(source, F.lit(f"({pattern})"), F.lit(1)), found)


def placed_back(at: Column, segments: Column, end: bool) -> Column:
    """An offset of the text in digits as one of the source: starts and ends within a number are those of its words."""
    known = F.filter(segments, lambda g: (g["ns"] < at) if end else (g["ns"] <= at))
    of = lambda g: F.when(g.isNull(), at).when((at <= g["ne"]) if end else (at < g["ne"]), g["oe"] if end else g["os"]).otherwise(at - g["ne"] + g["oe"])
    return text.bind(F.get(known, F.size(known) - 1), of).cast("long")
