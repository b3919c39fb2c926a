"""What dates, times and periods in words mean at a reference instant, by calendar arithmetic on Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import spoken, text

#: Days away, weeks (or days) away, and the hours of parts of a day, in the order of the words of `grammar.LANGUAGES`.
AWAY = {
    "en": {"today": 0, "tomorrow": 1, "yesterday": -1}, "de": {"heute": 0, "morgen": 1, "gestern": -1, "übermorgen": 2},
    "fr": {"aujourdhui": 0, "demain": 1, "hier": -1}, "es": {"hoy": 0, "mañana": 1, "ayer": -1},
}
WHICH = {
    "en": {"this": 0, "next": 1, "last": -1}, "de": {"diese": 0, "diesen": 0, "dieser": 0, "dieses": 0, "nächste": 1, "nächsten": 1, "nächster": 1, "nächstes": 1, "letzte": -1, "letzten": -1, "letzter": -1, "letztes": -1},
    "fr": {"ce": 0, "cet": 0, "cette": 0, "prochain": 1, "prochaine": 1, "dernier": -1, "dernière": -1}, "es": {"este": 0, "esta": 0, "próximo": 1, "próxima": 1, "último": -1, "última": -1},
}
PARTS = {
    "en": {"morning": (6, 12), "afternoon": (12, 18), "evening": (18, 22), "night": (22, 30), "tonight": (18, 24)}, "de": {"vormittag": (6, 12), "nachmittag": (12, 18), "abend": (18, 22), "nacht": (22, 30)},
    "fr": {"matin": (6, 12), "soir": (18, 22), "nuit": (22, 30)}, "es": {"tarde": (12, 20), "noche": (20, 30)},
}
PERIODS = {
    "en": {"week": "week", "weekend": "weekend", "month": "month", "year": "year"}, "de": {"woche": "week", "wochenende": "weekend", "monat": "month", "jahr": "year"},
    "fr": {"semaine": "week", "weekend": "weekend", "mois": "month", "année": "year"}, "es": {"semana": "week", "mes": "month", "año": "year"},
}
KINDS = ("date", "time", "datetime", "datePeriod", "timePeriod")
MEANT = "struct<kind:string,value:string,grain:string,precision:string,from:string,to:string>"
#: Years within which every day of the calendar comes again, 29 February over a century's end included.
AHEAD = 9


def _word(source: Column, words) -> Column:
    """The first of some words that stands in a text; null for none."""
    if not words:
        return F.lit(None).cast("string")
    listed = "|".join(sorted(words, key=len, reverse=True))
    return F.nullif(F.regexp_extract(source, rf"(?U)\b({listed})\b", 1), F.lit(""))


def _looked_up(word: Column, words: dict[str, object]) -> Column:
    out = F.lit(None)
    for w, value in words.items():
        out = F.when(word == w, F.lit(value)).otherwise(out)
    return out


def _part(source: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(source, pattern, group), F.lit("")).cast("int")


def _at(day: Column, seconds: Column) -> Column:
    """An instant of a day, by the session's clock; from 24 hours on those of the next day."""
    on = F.date_add(day, F.floor(seconds / 86_400).cast("int"))
    left = (seconds % 86_400).cast("int")
    return F.make_timestamp(F.year(on), F.month(on), F.dayofmonth(on), F.floor(left / 3600).cast("int"), F.floor(left % 3600 / 60).cast("int"), (left % 60).cast("decimal(8,6)"))


def _day(said: Column, today: Column, lang) -> Column:
    """The day that a text names: an ISO date, a day of a month (the next one there is), a weekday, or a day counted from today; null for none."""
    iso = F.when(said.rlike(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"), F.try_to_date(F.regexp_extract(said, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1), "yyyy-MM-dd"))
    name, words = lang.name, lang.words
    month = _looked_up(_word(said, words.months), {m: i for i, m in enumerate(words.months, 1)})
    number = _part(said, r"(?<![0-9:])([0-9]{1,2})(?![0-9:])(?!\s*(?:am|pm|uhr))")
    first = [F.make_date(F.year(today) + k, month, F.lit(1)) for k in range(AHEAD)]
    of_month = F.coalesce(*[F.when((number <= F.dayofmonth(F.last_day(f))) & (F.date_add(f, number - 1) >= today), F.date_add(f, number - 1)) for f in first])
    weekday = _looked_up(_word(said, words.weekdays), {w: i for i, w in enumerate(words.weekdays)})
    which, monday, now = _looked_up(_word(said, WHICH[name]), WHICH[name]), F.trunc(today, "week").cast("date"), F.weekday(today)
    on_weekday = F.when(which == -1, F.date_sub(today, (now - weekday + 6) % 7 + 1)).when(which.isNotNull(), F.date_add(monday, (weekday + 7 * which).cast("int"))).otherwise(F.date_add(today, (weekday - now + 6) % 7 + 1))
    away = _looked_up(_word(said, AWAY[name]), AWAY[name])
    return F.coalesce(iso, F.when(month.isNotNull() & number.isNotNull(), of_month), F.when(weekday.isNotNull(), on_weekday), F.date_add(today, away.cast("int")))


def _time(said: Column, lang) -> tuple[Column, Column]:
    """Seconds of the day of a time in a text, and whether minutes are said."""
    words = lang.words
    noon = {w: h for w, h in zip(words.hours, (12, 0))}
    clock = F.regexp_extract(said, r"(?<![0-9])([0-9]{1,2}):([0-9]{2})(?![0-9])", 1)
    half = F.nullif(F.regexp_extract(said, r"[0-9]\s*(am|pm)\b", 1), F.lit(""))
    hour = F.coalesce(F.nullif(clock, F.lit("")), F.nullif(F.regexp_extract(said, r"(?<![0-9])([0-9]{1,2})\s*(?:am|pm|uhr)\b", 1), F.lit(""))).cast("int")
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    minute = _part(said, r"(?<![0-9])[0-9]{1,2}:([0-9]{2})(?![0-9])")
    return F.coalesce(hour, _looked_up(_word(said, noon), noon)) * 3600 + F.coalesce(minute, F.lit(0)) * 60, minute.isNotNull()


class _Lang:
    def __init__(self, name: str) -> None:
        from parlance.operators.grammar import LANGUAGES

        self.name, self.words = name, LANGUAGES[name]


def _instant(said: Column, reference: Column, lang: _Lang) -> Column:
    """Struct of at and grain: a day, a time of it, or the next such time after the reference instant. Null if a text names neither."""
    today = F.to_date(reference)

    def of(day: Column) -> Column:
        seconds, exact = _time(said, lang)
        grain = F.when(seconds.isNull(), "Day").when(exact, "Minute").otherwise("Hour")

        def placed(s: Column) -> Column:
            next_ = F.when(_at(today, s) > reference, _at(today, s)).otherwise(_at(F.date_add(today, 1), s))
            return F.when(day.isNotNull(), _at(day, F.coalesce(s, F.lit(0)))).when(s.isNotNull(), next_)

        return F.struct(text.bind(seconds, placed).alias("at"), grain.alias("grain"))

    return text.bind(_day(said, today, lang), of)


def _period(said: Column, reference: Column, lang: _Lang) -> Column:
    """Struct of start and stop of a period that a text names: a week, weekend, month or year this or that far away, a month by its name, or a part of a day."""
    today, words, name = F.to_date(reference), lang.words, lang.name
    which = F.coalesce(_looked_up(_word(said, WHICH[name]), WHICH[name]), F.lit(0)).cast("int")
    unit = _looked_up(_word(said, PERIODS[name]), PERIODS[name])
    monday = F.date_add(F.trunc(today, "week").cast("date"), which * 7)
    month = F.add_months(F.trunc(today, "month"), which)
    year = F.add_months(F.trunc(today, "year"), which * 12)
    named = _looked_up(_word(said, words.months), {m: i for i, m in enumerate(words.months, 1)})
    of_name = F.make_date(F.year(today) + F.when(named < F.month(today), 1).otherwise(0), named, F.lit(1))
    hours = PARTS[name]
    part = _word(said, hours)
    begins, ends = _looked_up(part, {w: h[0] for w, h in hours.items()}), _looked_up(part, {w: h[1] for w, h in hours.items()})
    midnight = lambda d: _at(d, F.lit(0))
    span = lambda a, b: F.struct(midnight(a).alias("start"), midnight(b).alias("stop"))
    bare = _word(said, WHICH[name]).isNull() & (_at(today, ends * 3600) <= reference)
    on = F.date_add(today, F.when(bare, 1).otherwise(which))
    return (
        F.when(unit == "week", span(monday, F.date_add(monday, 7)))
        .when(unit == "weekend", span(F.date_add(monday, 5), F.date_add(monday, 7)))
        .when(unit == "month", span(month, F.add_months(month, 1)))
        .when(unit == "year", span(year, F.add_months(year, 12)))
        .when(part.isNotNull(), F.struct(_at(on, begins * 3600).alias("start"), _at(on, ends * 3600).alias("stop")))
        .when(named.isNotNull(), span(of_name, F.add_months(of_name, 1)))
    )


def with_meaning(df: DataFrame, kind: str, value: str, reference: Column, language: str = "en", name: str = "meant") -> DataFrame:
    """df with what a date, time or period means at a reference instant, as a struct of kind (InstantTime or TimeInterval), value, grain and precision (of an instant), from and to (of an interval; an open
    one has one of them). Null for other kinds, for languages without words, for texts that name no time, and where the reference is null.

    A weekday alone is the next one, today's not included; next and last ones lie in the next week and before today. A day of a month is the next one that there is. A time alone is the next one. A
    part of a day is today's unless it is over. Weeks begin on Monday. Clock times are those of the session's time zone, as are the days of the reference instant.
    """
    if language not in AWAY:
        return df.withColumn(name, F.lit(None).cast(MEANT))
    lang, keep = _Lang(language), df.columns
    words = lang.words
    any_of = lambda ws: "|".join(ws) or "(?!)"
    out = df.withColumn("__d", spoken.in_digits(F.lower(F.col(value)), language)).select(*keep, F.col("__d.text").alias("__v"), reference.alias("__ref"))
    joined = rf"(?U)^(?:(?:{any_of(words.between)})\s+)?(.+?)(?:\s+(?:{any_of((*words.upto, *words.also))})\s+|\s*-\s*)(.+)$"
    lead = lambda ws: F.col("__v").rlike(rf"(?U)^(?:{any_of(ws)})\s")
    is_period, is_iso = F.col(kind).isin("datePeriod", "timePeriod"), F.col("__v").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    both = is_period & F.col("__v").rlike(joined) & ~is_iso & ~lead((*words.before,))
    left, right = F.regexp_extract("__v", joined, 1), F.regexp_extract("__v", joined, 2)
    half = F.regexp_extract(right, r"(am|pm|uhr)\s*$", 1)
    left = F.when(left.rlike("^[0-9]{1,2}$"), F.concat_ws(" ", left, F.when(half != "", half))).otherwise(left)
    open_ = F.when(is_period & ~both & lead(words.before), "before").when(is_period & ~both & lead((*words.after, *words.between)), "after")
    out = out.withColumn("__form", F.when(both, "interval").otherwise(open_))
    out = out.withColumn("__ends", F.when(F.col("__form") == "interval", F.array(left, right)).otherwise(F.array("__v")))
    out = out.withColumn("__at", F.transform("__ends", lambda v: _instant(v, F.col("__ref"), lang)))
    out = out.withColumn("__span", F.when(is_period & F.col("__form").isNull(), _period(F.col("__v"), F.col("__ref"), lang)))
    said = lambda at: F.date_format(at, "yyyy-MM-dd HH:mm:ss xxx")
    none = F.lit(None).cast("string")
    start, stop = F.get("__at", 0), F.get("__at", 1)
    # the second end is the first after the first one: friday to monday is three days
    later = F.when(stop["at"] > start["at"], stop["at"]).otherwise(F.when(start["grain"] == "Day", stop["at"] + F.expr("INTERVAL 7 DAYS")).otherwise(stop["at"] + F.expr("INTERVAL 1 DAY")))
    interval = lambda a, b: F.struct(F.lit("TimeInterval").alias("kind"), none.alias("value"), none.alias("grain"), none.alias("precision"), said(a).alias("from"), said(b).alias("to"))
    instant = F.struct(F.lit("InstantTime").alias("kind"), said(start["at"]).alias("value"), start["grain"].alias("grain"), F.lit("Exact").alias("precision"), none.alias("from"), none.alias("to"))
    missing = F.lit(None).cast("timestamp")
    meant = (
        F.when(~F.col(kind).isin(*KINDS) | F.col("__ref").isNull(), None)
        .when((F.col("__form") == "interval") & start["at"].isNotNull() & stop["at"].isNotNull(), interval(start["at"], later))
        .when((F.col("__form") == "before") & start["at"].isNotNull(), interval(missing, start["at"]))
        .when((F.col("__form") == "after") & start["at"].isNotNull(), interval(start["at"], missing))
        .when(F.col("__span").isNotNull(), interval(F.col("__span.start"), F.col("__span.stop")))
        .when(~is_period & start["at"].isNotNull(), instant)
    )
    return out.select(*keep, meant.cast(MEANT).alias(name))
