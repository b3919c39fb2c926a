"""Builtin grammars: numbers, money, durations, dates and times, read from a token and its neighbours, for several languages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import spoken, text

CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP"}


@dataclass(frozen=True)
class Language:
    """The words that the grammars of a language read, in lower case, and what stands for them."""

    units: dict[str, str]
    ordinal: str
    degrees: tuple[str, ...]
    scales: dict[str, str]
    days: tuple[str, ...]
    weekdays: tuple[str, ...]
    months: tuple[str, ...]
    hours: tuple[str, ...]
    halves: tuple[str, ...]
    which: tuple[str, ...]
    periods: tuple[str, ...]
    parts: tuple[str, ...]
    evenings: tuple[str, ...]
    at: tuple[str, ...]
    of: tuple[str, ...]
    money: dict[str, str]
    percent: tuple[str, ...]
    #: What joins the parts of a compound and the ends of an interval, what stands before an interval's first end, and before the one end of an open interval.
    also: tuple[str, ...]
    upto: tuple[str, ...]
    between: tuple[str, ...]
    before: tuple[str, ...]
    after: tuple[str, ...]


def _w(words: str) -> tuple[str, ...]:
    return tuple(words.split())


def _units(words: str) -> dict[str, str]:
    return {w: unit for unit, forms in zip(("second", "minute", "hour", "day", "week", "month", "year"), words.split(";")) for w in forms.split()}


def _money(words: str) -> dict[str, str]:
    return {w: sign for sign, forms in zip("$€£", words.split(";")) for w in forms.split()}


#: Units of time by how long they are in the first of them that is shorter; compounds are counted within these families.
CLOCK = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
CALENDAR_UNITS = {"month": 1, "year": 12}
LANGUAGES = {
    "en": Language(
        _units("second seconds;minute minutes;hour hours;day days;week weeks;month months;year years"), "^[0-9]+(st|nd|rd|th)$", _w("degree degrees"), {"celsius": "celsius", "fahrenheit": "fahrenheit"},
        _w("today tomorrow yesterday"), _w("monday tuesday wednesday thursday friday saturday sunday"), _w("january february march april may june july august september october november december"),
        _w("noon midnight"), _w("am pm"), _w("this next last"), _w("week weekend month year"), _w("morning afternoon evening night"), _w("tonight"), _w("at"), _w("of"), _money("dollar dollars;euro euros;pound pounds"), _w("percent"), _w("and"), _w("to until till through"), _w("between from"), _w("before until by till"), _w("after since"),
    ),
    "de": Language(
        _units("sekunde sekunden;minute minuten;stunde stunden;tag tage tagen;woche wochen;monat monate monaten;jahr jahre jahren"), "^[0-9]+(te|ter|ten|tes)$", _w("grad"), {"celsius": "celsius", "fahrenheit": "fahrenheit"},
        _w("heute morgen gestern übermorgen"), _w("montag dienstag mittwoch donnerstag freitag samstag sonntag"), _w("januar februar märz april mai juni juli august september oktober november dezember"),
        _w("mittag mitternacht"), _w("uhr"), _w("diese diesen dieser dieses nächste nächsten nächster nächstes letzte letzten letzter letztes"), _w("woche wochenende monat jahr"), _w("vormittag nachmittag abend nacht"), (), _w("um"), (), _money("dollar;euro;pfund"), _w("prozent"), _w("und"), _w("bis"), _w("zwischen von vom"), _w("vor bis"), _w("nach seit ab"),
    ),
    "fr": Language(
        _units("seconde secondes;minute minutes;heure heures;jour jours;semaine semaines;mois;an ans année années"), "^[0-9]+(er|ère|e|ème)$", _w("degré degrés"), {"celsius": "celsius", "fahrenheit": "fahrenheit"},
        _w("aujourdhui demain hier"), _w("lundi mardi mercredi jeudi vendredi samedi dimanche"), _w("janvier février mars avril mai juin juillet août septembre octobre novembre décembre"),
        _w("midi minuit"), (), _w("ce cet cette prochain prochaine dernier dernière"), _w("semaine weekend mois année"), _w("matin soir nuit"), (), _w("à"), _w("de"), _money("dollar dollars;euro euros;livre livres"), _w("pourcent"), _w("et"), _w("à"), _w("entre de"), _w("avant"), _w("après depuis"),
    ),
    "es": Language(
        _units("segundo segundos;minuto minutos;hora horas;día días;semana semanas;mes meses;año años"), "^[0-9]+(º|ª|o|a|er)$", _w("grado grados"), {"celsius": "celsius", "centígrados": "celsius", "fahrenheit": "fahrenheit"},
        _w("hoy mañana ayer"), _w("lunes martes miércoles jueves viernes sábado domingo"), _w("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"),
        _w("mediodía medianoche"), (), _w("este esta próximo próxima último última"), _w("semana mes año"), _w("tarde noche"), (), _w("a"), _w("de"), _money("dólar dólares;euro euros;libra libras"), (), _w("y"), _w("a hasta"), _w("entre de desde"), _w("hasta"), _w("desde"),
    ),
}
#: Examples of each kind, with which training fills slots beside the values that a dataset has for them.
EXAMPLES = {
    "number": ("32", "4.5", "100"), "amountOfMoney": ("$20.50", "$8"), "duration": ("45 minutes", "2 weeks"), "ordinal": ("3rd", "21st"), "temperature": ("21 degrees celsius", "70 degrees"), "percentage": ("15%", "2.5%"),
    "date": ("2031-05-17", "next friday", "march 5"), "time": ("17:45", "5 pm", "noon"), "datetime": ("tomorrow at 5 pm", "friday"), "datePeriod": ("next week", "june"), "timePeriod": ("this evening", "tonight"),
}
#: Kinds that grammars read, and those of them that may begin with a word, and not only with a digit.
KINDS = ("number", "percentage", "amountOfMoney", "ordinal", "temperature", "duration", "date", "time", "datetime", "datePeriod", "timePeriod")
CALENDAR = ("date", "time", "datetime", "datePeriod", "timePeriod")


def _looked_up(words: dict[str, str], word: Column) -> Column:
    return F.coalesce(*[F.when(word.isin(*[w for w, v in words.items() if v == value]), value) for value in dict.fromkeys(words.values())])


ENTITIES = "array<struct<kind:string,s:bigint,e:bigint,value:string,number:double,unit:string>>"


def with_entities(df: DataFrame, source: str, kinds: tuple[str, ...], language: str = "en", name: str = "found") -> DataFrame:
    """df with the builtin entities of a text column as an array of structs (kind, s, e, value, number, unit), each kind matched for itself; none for a null text. Languages without words of their
    own have numbers, percentages, amounts of money, ISO dates and clock times.

    Numbers may be in words: the grammars read the text with its numbers in digits (`spoken.in_digits`), and what they find is placed back. Durations that follow each other from larger
    to smaller units are one; its number and unit are those of the smallest unit, or null where months meet days. Times and dates may be ends of an interval, or the one end of an open one:
    periods whose unit is `interval`, `before` or `after`. All of it happens within the row, step by step in columns of their own, so that each is computed once.
    """
    kinds = tuple(k for k in kinds if k in KINDS)
    if not kinds:
        return df.withColumn(name, F.array().cast(ENTITIES))
    keep, steps = df.columns, _steps(kinds, language)
    digits = spoken.in_digits(F.col(source), language) if language in spoken.LANGUAGES else F.struct(F.col(source).alias("text"), F.array().cast(spoken.SEGMENTS).alias("segments"))
    out = df.withColumn("__d", digits).select(*keep, F.col("__d.text").alias("__text"), F.col("__d.segments").alias("__segments"))
    out = out.withColumn("__pieces", text.cut_pieces(F.col("__text")))
    out = out.withColumn("__toks", text.numbered(F.col("__pieces"))).withColumn("__found", F.array().cast("array<string>"))
    for step in steps:
        out = out.withColumn("__found", step(F.col("__pieces"), F.col("__toks"), F.col("__found")))
    back = lambda m: F.struct(spoken.placed_back(m["s"], F.col("__segments"), False).alias("s"), spoken.placed_back(m["e"], F.col("__segments"), True).alias("e"))
    moved = lambda m: text.bind(back(m), lambda at: F.struct(m["kind"].alias("kind"), at["s"].alias("s"), at["e"].alias("e"), F.substr(F.col(source), (at["s"] + 1).cast("int"), (at["e"] - at["s"]).cast("int")).alias("value"), m["number"].alias("number"), m["unit"].alias("unit")))
    return out.select(*keep, F.when(F.size("__segments") > 0, F.transform("__found", moved)).otherwise(F.col("__found")).alias(name))


def _steps(kinds: tuple[str, ...], language: str) -> list[Callable[[Column, Column, Column], Column]]:
    """What is found in a text whose numbers are in digits, step by step: functions of its pieces, its tokens and what was found before."""
    none = Language({}, "^(?!)", (), {}, (), (), (), (), (), (), (), (), (), (), (), {}, (), (), (), (), (), ())
    lang = LANGUAGES.get(language, none)
    yes = lambda c: F.coalesce(c, F.lit(False))
    low = lambda t: F.lower(t["value"])
    digits = lambda t: yes(t["value"].rlike("^[0-9]+$"))
    of = lambda t, words: yes(low(t).isin(*words)) if words else F.lit(False)
    beside = lambda t: yes(t["gap"].rlike(r"^\s+$"))
    calendar = any(k in kinds for k in CALENDAR)
    spans = any(k in kinds for k in ("datePeriod", "timePeriod")) and bool(lang.upto)
    #: Kinds that are read because others are made of them.
    read = {*kinds, *(("date", "time") if "datetime" in kinds else ()), *(("date", "time", "number") if spans else ())}
    words = sorted({*lang.days, *lang.weekdays, *lang.months, *lang.hours, *lang.which, *lang.parts, *lang.evenings}) if calendar else []
    lit = F.lit

    def at(pieces: Column, toks: Column, t: Column, i: Column) -> Column:
        # tests are in the order of their cost: what stands between tokens and words that are looked up go before patterns
        def of_digit(x: Column) -> Column:
            back, one, two = x["back"], x["one"], x["two"]
            fraction = (t["gap"] == ".") & digits(one)
            whole = digits(t)
            own = F.struct(
                (whole & ~yes((back["gap"] == ".") & digits(back))).alias("is"), whole.alias("digits"), yes((t["gap"] == ":") & t["value"].rlike("^([01]?[0-9]|2[0-3])$") & one["value"].rlike("^[0-5][0-9]$")).alias("clock"),
                F.when(fraction, one).otherwise(t).alias("last"), F.when(fraction, two).otherwise(one).alias("after"), F.when(fraction, x["three"]).otherwise(two).alias("later"), F.lower(F.when(fraction, two).otherwise(one)["value"]).alias("word"),
            )
            return text.bind(own, lambda n: begun_by_digit(back, one, two, n))

        empty, whole = lit(None), lit(None)
        half = lambda c: of(c, lang.halves)
        day = lambda c: yes(c["value"].rlike("^([12]?[0-9]|3[01])$")) | (low(c).rlike(lang.ordinal))

        def begun_by_digit(back: Column, one: Column, two: Column, n: Column) -> Column:
            last, after, later = n["last"], n["after"], n["later"]
            value = F.when(n["is"], text.covered(pieces, t, last)).cast("double")
            touching = (last["e"] == after["s"]) & (after["value"] == "%")
            money = back["value"].isin(*CURRENCIES) & (back["e"] == t["s"])
            scale = of(later, tuple(lang.scales))
            follows = lambda words: yes(n["word"].isin(*words)) if words else lit(False)
            iso = (t["gap"] == "-") & (one["gap"] == "-") & t["value"].rlike("^[0-9]{4}$") & one["value"].rlike("^[0-9]{2}$") & two["value"].rlike("^[0-9]{2}$")
            found = [
                ("number", n["is"], t, last, value, empty),
                ("percentage", n["is"] & (touching | follows(lang.percent)), t, after, value, empty),
                ("amountOfMoney", n["is"] & money, back, last, value, back["value"]),
                ("amountOfMoney", n["is"] & follows(tuple(lang.money)) & ~money, t, after, value, _looked_up(lang.money, n["word"]) if lang.money else empty),
                ("ordinal", ~n["digits"] & yes(low(t).rlike(lang.ordinal)), t, t, F.regexp_extract(t["value"], "^([0-9]+)", 1).cast("double"), empty),
                ("temperature", n["is"] & follows(lang.degrees), t, F.when(scale, later).otherwise(after), value, F.when(scale, _looked_up(lang.scales, low(later))) if lang.scales else empty),
                ("duration", n["is"] & follows(tuple(lang.units)), t, after, value, _looked_up(lang.units, n["word"]) if lang.units else empty),
                ("date", iso, t, two, whole, empty),
                ("time", n["clock"] & ~(half(two) & beside(one)), t, one, whole, empty),
            ]
            if calendar and lang.weekdays:
                found += [
                    ("time", n["clock"] & half(two) & beside(one), t, two, whole, empty),
                    ("time", n["digits"] & half(one) & beside(t) & ~yes(back["gap"] == ":"), t, one, whole, empty),
                    ("date", of(one, lang.months) & beside(t) & day(t), t, one, whole, empty),
                    ("date", of(one, lang.of) & of(two, lang.months) & day(t), t, two, whole, empty),
                ]
            return listed(found)

        def begun_by_word(back: Column, one: Column) -> Column:
            which_before, which_after = of(back, lang.which) & beside(back), of(one, lang.which) & beside(t)
            return listed([
                ("time", of(t, lang.hours), t, t, whole, empty),
                ("date", of(t, lang.days), t, t, whole, empty),
                ("date", of(t, lang.weekdays), F.when(which_before, back).otherwise(t), F.when(which_after, one).otherwise(t), whole, empty),
                ("date", of(t, lang.months) & beside(t) & day(one), t, one, whole, empty),
                ("datePeriod", of(t, lang.which) & of(one, lang.periods) & beside(t), t, one, whole, low(one)),
                ("datePeriod", of(t, lang.months) & ~yes(day(one) & beside(t)) & ~yes(day(back) & beside(back)) & ~of(back, lang.of), t, t, whole, lit("month")),
                ("timePeriod", of(t, lang.parts), F.when(which_before, back).otherwise(t), t, whole, empty),
                ("timePeriod", of(t, lang.evenings), t, t, whole, empty),
            ])

        def listed(found: list[tuple]) -> Column:
            return F.array_compact(F.array(*[
                F.when(yes(test), F.struct(lit(kind).alias("kind"), a["i"].alias("a"), z["i"].alias("z"), v.cast("double").alias("number"), u.cast("string").alias("unit")))
                for kind, test, a, z, v, u in found if kind in read
            ]))

        around = F.struct(*[F.get(toks, i + k).alias(c) for k, c in ((-1, "back"), (1, "one"), (2, "two"), (3, "three"))])
        # every grammar begins with a digit or with one of few words, so other tokens cost a comparison and a look-up
        begins = (t["value"] >= "0") & (t["value"] < ":")
        digit = F.when(begins, text.bind(around, of_digit))
        return digit.when(low(t).isin(*words), text.bind(around, lambda x: begun_by_word(x["back"], x["one"]))) if words else digit

    def joined(toks: Column, found: Column) -> Column:
        """With datetimes: a date with the time behind it, and every date and time that is in none of these."""

        def behind(d: Column) -> Column:
            follows = lambda m: (m["kind"] == "time") & ((m["a"] == d["z"] + 1) | ((m["a"] == d["z"] + 2) & of(F.get(toks, (d["z"] + 1).cast("int")), lang.at)))
            return F.get(F.filter(found, follows), 0)

        dates, times = F.filter(found, lambda m: m["kind"] == "date"), F.filter(found, lambda m: m["kind"] == "time")
        both = F.transform(dates, lambda d: F.struct(lit("datetime").alias("kind"), d["a"].alias("a"), F.coalesce(behind(d)["z"], d["z"]).alias("z"), lit(None).cast("double").alias("number"), lit(None).cast("string").alias("unit")))
        alone = lambda bs: F.transform(F.filter(times, lambda m: ~F.exists(bs, lambda b: (b["a"] <= m["a"]) & (m["z"] <= b["z"]))), lambda m: F.struct(lit("datetime").alias("kind"), m["a"].alias("a"), m["z"].alias("z"), m["number"].alias("number"), m["unit"].alias("unit")))
        return text.bind(both, lambda bs: F.concat(found, bs, alone(bs)))

    def compound(toks: Column, found: Column) -> Column:
        """With durations that follow each other, from larger to smaller units, made one."""
        size = lambda u: F.coalesce(*[F.when(u == name, k * (1 if name in CLOCK else 10**7)) for name, k in [*CLOCK.items(), *CALENDAR_UNITS.items()]])
        is_clock = lambda u: u.isin(*CLOCK)
        item = lambda m: F.struct(m["kind"].alias("kind"), m["a"].alias("a"), m["z"].alias("z"), m["number"].alias("number"), m["unit"].alias("unit"), m["unit"].alias("least"))
        durations = F.array_sort(F.transform(F.filter(found, lambda m: m["kind"] == "duration"), item), lambda x, y: (x["a"] - y["a"]).cast("int"))

        def add(acc: Column, d: Column) -> Column:
            def one(last: Column) -> Column:
                near = (d["a"] == last["z"] + 1) | ((d["a"] == last["z"] + 2) & of(F.get(toks, (last["z"] + 1).cast("int")), lang.also))
                follows = yes(near & (size(d["unit"]) < size(last["least"])))
                same = yes(is_clock(last["unit"]) == is_clock(d["unit"]))
                both = F.struct(last["kind"].alias("kind"), last["a"].alias("a"), d["z"].alias("z"), F.when(same, last["number"] * size(last["unit"]) / size(d["unit"]) + d["number"]).alias("number"), F.when(same, d["unit"]).alias("unit"), d["least"].alias("least"))
                return F.when(follows, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), both)).otherwise(F.array_append(acc, d))

            return F.when(F.size(acc) > 0, text.bind(F.element_at(acc, -1), one)).otherwise(F.array(d))

        plain = lambda m: F.struct(*[m[c].alias(c) for c in ("kind", "a", "z", "number", "unit")])
        held = F.transform(F.aggregate(durations, F.filter(durations, lambda _: lit(False)), add), plain)
        return F.when(F.size(F.filter(found, lambda m: m["kind"] == "duration")) > 1, F.concat(F.filter(found, lambda m: m["kind"] != "duration"), held)).otherwise(found)

    def intervals(toks: Column, found: Column) -> Column:
        """With periods from one date or time to another, and before or after one."""
        alone = lambda m: F.exists(found, lambda x: x["kind"].isin("date", "time") & (x["a"] == m["a"]) & (x["z"] == m["z"]))
        ends = F.filter(found, lambda m: m["kind"].isin("date", "time") | ((m["kind"] == "datetime") & ~alone(m)))
        before = lambda i: F.get(toks, (i - 1).cast("int"))
        period = lambda m, a, what: F.struct(F.when(m["kind"] == "time", "timePeriod").otherwise("datePeriod").alias("kind"), a.alias("a"), m["z"].alias("z"), lit(None).cast("double").alias("number"), lit(what).alias("unit"))

        def of_end(m: Column) -> Column:
            joined, open_ = of(before(m["a"]), lang.upto), of(before(m["a"]), lang.also)
            starts = F.filter(found, lambda x: (x["z"] == m["a"] - 2) & (joined | open_) & (x["kind"].isin("date", "time", "datetime") & (x["kind"] == m["kind"]) | (x["kind"] == "number") & (m["kind"] == "time")))

            def of_start(x: Column) -> Column:
                led = of(before(x["a"]), lang.between)
                return F.when(x.isNotNull() & led, period(m, x["a"] - 1, "interval")).when(x.isNotNull() & joined, period(m, x["a"], "interval"))

            return text.bind(F.array_min(F.transform(starts, lambda x: F.struct(x["a"].alias("a"), x["z"].alias("z")))), lambda x: F.coalesce(of_start(x), F.when(of(before(m["a"]), lang.before), period(m, m["a"] - 1, "before")), F.when(of(before(m["a"]), lang.after), period(m, m["a"] - 1, "after"))))

        # "from monday" is the start of "from monday to friday"
        within = lambda ps, p: F.exists(ps, lambda q: (q["unit"] == "interval") & (q["a"] <= p["a"]) & (p["z"] <= q["z"]))
        whole = lambda ps: F.filter(ps, lambda p: (p["unit"] == "interval") | ~within(ps, p))
        return F.when(F.size(ends) > 0, F.concat(found, text.bind(F.array_compact(F.transform(ends, of_end)), whole))).otherwise(found)

    def spread(pieces: Column, toks: Column, _: Column) -> Column:
        return F.flatten(F.array_compact(F.transform(toks, lambda t, i: at(pieces, toks, t, i))))

    def placed(pieces: Column, toks: Column, ms: Column) -> Column:
        ms = F.filter(ms, lambda m: m["kind"].isin(*kinds)) if read != set(kinds) else ms
        return F.transform(ms, lambda m: text.bind(F.struct(F.get(toks, m["a"].cast("int")).alias("a"), F.get(toks, m["z"].cast("int")).alias("z")), lambda b: F.struct(
            m["kind"].alias("kind"), b["a"]["s"].alias("s"), b["z"]["e"].alias("e"), text.covered(pieces, b["a"], b["z"]).alias("value"), m["number"].alias("number"), m["unit"].alias("unit"))))

    steps = [spread]
    if "duration" in kinds and lang.units:
        steps.append(lambda _, toks, ms: compound(toks, ms))
    if "datetime" in kinds:
        steps.append(lambda _, toks, ms: joined(toks, ms))
    if spans:
        steps.append(lambda _, toks, ms: intervals(toks, ms))
    return [*steps, placed]
