"""Numbers in words, compounds and intervals, and what dates and times mean."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import spoken
from parlance.operators import calendar, entities, grammar

SAID = {
    ("en", 121): "one hundred and twenty-one", ("en", 1_060): "one thousand and sixty", ("en", 2_300_215): "two million, three hundred thousand, two hundred and fifteen",
    ("de", 121): "einhunderteinundzwanzig", ("de", 101_001): "einhunderteintausendeins", ("de", 2_000_304): "zwei Millionen dreihundertvier", ("de", 16): "sechzehn",
    ("fr", 71): "soixante et onze", ("fr", 80_000): "quatre-vingt mille", ("fr", 297): "deux cent quatre-vingt-dix-sept", ("fr", 1_200): "mille deux cents",
    ("es", 21_000): "veintiún mil", ("es", 100): "cien", ("es", 31_000_500): "treinta y un millones quinientos", ("es", 1_000_000): "un millón",
}


def test_numbers_are_spelled_by_the_rules_of_each_language(spark):
    for lang in spoken.LANGUAGES:
        rows = spark.createDataFrame([(n,) for la, n in SAID if la == lang] + [(0,), (-1,), (10**9,)], "n long").select("n", spoken.spell(F.col("n"), lang).alias("w"))
        got = {r["n"]: r["w"] for r in rows.collect()}
        assert {n: got[n] for la, n in SAID if la == lang} == {n: w for (la, n), w in SAID.items() if la == lang}
        assert got[0] == spoken.ZERO[lang] and got[-1] is None and got[10**9] is None
    assert spark.range(1).select(spoken.spell(F.lit(3), "ja")).first()[0] is None


@pytest.mark.parametrize("lang", spoken.LANGUAGES)
def test_what_is_spelled_is_read_back_with_its_place(spark, lang):
    rng = random.Random(lang)
    numbers = sorted({*range(2, 130), *(rng.randrange(2, 10 ** rng.randrange(2, 10)) for _ in range(300)), 999_999_999, 10**6, 10**6 + 1, 21_000, 101_000, 80_000, 1_001_000, 401_286_598})
    texts = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", spoken.spell(F.col("n"), lang).alias("w")).select("n", "w", F.concat(F.lit("é🙂 (: "), F.initcap("w"), F.lit(", ok")).alias("text"))
    got = entities.builtin_matches(texts, ["n", "w"], ("number",), lang).collect()
    assert {(r["n"], r["number"], r["s"], r["e"], r["value"].lower()) for r in got} == {(n, n, 6, 6 + len(r["w"]), r["w"].lower()) for r in got for n in [r["n"]]} and len(got) == len(numbers)


@pytest.mark.parametrize(
    ("lang", "text", "read"),
    [
        ("en", "the twenty-first and the second visit", "the 21th and the 2th visit"), ("en", "wait one second please", "wait 1 second please"), ("en", "two thousand and three, one", "2003, 1"), ("en", "a hundred people, no atone or onerous ones", "100 people, no atone or onerous ones"),
        ("en", "TWENTY two degrees", "22 degrees"), ("en", "two three", "2 3"), ("en", "", ""), ("en", "no numbers", "no numbers"), ("en", " five", " 5"), ("de", "ein Mann hat einundzwanzig Äpfel und eine Stunde", "ein Mann hat 21 Äpfel und 1 Stunde"),
        ("de", "der dritte, am einundzwanzigsten, Achtung Einhorn", "der 3te, am 21te, Achtung Einhorn"), ("fr", "un chat, une heure, quatre-vingt-dix-sept jours, le troisième", "un chat, 1 heure, 97 jours, le 3e"), ("es", "un día y dos mil veintiún pesos, la tercera", "1 día y 2021 pesos, la 3o"),
    ],
)
def test_phrases_in_digits(spark, lang, text, read):
    frame = spark.createDataFrame([(text,), (None,)], "t string").select(spoken.in_digits(F.col("t"), lang).alias("d"))
    got = [r["d"]["text"] for r in frame.collect()]
    assert got == [read, None]


@pytest.mark.parametrize(
    ("lang", "text", "kind", "want"),
    [
        ("en", "twenty two degrees celsius", "temperature", [("twenty two degrees celsius", 22, "celsius")]), ("en", "twenty percent of forty dollars", "percentage", [("twenty percent", 20, None)]), ("en", "twenty percent of forty dollars", "amountOfMoney", [("forty dollars", 40, "$")]),
        ("en", "2 hours and thirty minutes", "duration", [("2 hours and thirty minutes", 150, "minute")]), ("en", "30 minutes and 2 hours", "duration", [("30 minutes", 30, "minute"), ("2 hours", 2, "hour")]), ("en", "one year and 3 days", "duration", [("one year and 3 days", None, None)]),
        ("en", "2 weeks, 1 day, 1 hour", "duration", [("2 weeks, 1 day, 1 hour", 361, "hour")]), ("de", "drei Tage und zwei Stunden", "duration", [("drei Tage und zwei Stunden", 74, "hour")]), ("fr", "deux heures et trente minutes", "duration", [("deux heures et trente minutes", 150, "minute")]),
        ("en", "between 3 and 5 pm", "timePeriod", [("between 3 and 5 pm", None, "interval")]), ("en", "3 to 5 pm", "timePeriod", [("3 to 5 pm", None, "interval")]), ("en", "from monday to friday", "datePeriod", [("from monday to friday", None, "interval")]), ("en", "3 and 5 pm", "timePeriod", []),
        ("en", "before noon, after friday", "timePeriod", [("before noon", None, "before")]), ("en", "before noon, after friday", "datePeriod", [("after friday", None, "after")]), ("en", "from tomorrow at 5 pm to friday at noon", "datePeriod", [("from tomorrow at 5 pm to friday at noon", None, "interval")]),
        ("ja", "5 and twenty", "number", [("5", 5, None)]),
    ],
)
def test_compounds_and_intervals(spark, lang, text, kind, want):
    kinds = grammar.KINDS if kind.endswith("Period") else (kind,)
    got = [(r["value"], r["number"], r["unit"]) for r in entities.builtin_matches(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), ["id"], kinds, lang).where(F.col("kind") == kind).collect()]
    assert [g for g in got if kind != "datePeriod" or "tomorrow at" not in text or g[2] == "interval"] == want


#: Wednesday, in a leap year.
REFERENCE = "2024-02-28 10:30:00"
MEANT = {
    ("date", "tomorrow"): "2024-02-29 00", ("date", "friday"): "2024-03-01 00", ("date", "wednesday"): "2024-03-06 00", ("date", "next friday"): "2024-03-08 00", ("date", "last wednesday"): "2024-02-21 00", ("date", "this sunday"): "2024-03-03 00", ("date", "february 29"): "2024-02-29 00",
    ("date", "february 27"): "2025-02-27 00", ("date", "5 of march"): "2024-03-05 00", ("date", "2031-05-17"): "2031-05-17 00", ("date", "2031-02-30"): None, ("time", "5 pm"): "2024-02-28 17", ("time", "five am"): "2024-02-29 05", ("time", "noon"): "2024-02-28 12", ("time", "midnight"): "2024-02-29 00",
    ("datetime", "tomorrow at 5 pm"): "2024-02-29 17", ("datePeriod", "next week"): ("2024-03-04 00", "2024-03-11 00"), ("datePeriod", "last month"): ("2024-01-01 00", "2024-02-01 00"), ("datePeriod", "this weekend"): ("2024-03-02 00", "2024-03-04 00"), ("datePeriod", "january"): ("2025-01-01 00", "2025-02-01 00"),
    ("datePeriod", "from monday to friday"): ("2024-03-04 00", "2024-03-08 00"), ("datePeriod", "from friday to monday"): ("2024-03-01 00", "2024-03-04 00"), ("timePeriod", "between 3 and 5 pm"): ("2024-02-28 15", "2024-02-28 17"), ("timePeriod", "before noon"): (None, "2024-02-28 12"), ("timePeriod", "after 5 pm"): ("2024-02-28 17", None),
    ("timePeriod", "tonight"): ("2024-02-28 18", "2024-02-29 00"), ("timePeriod", "night"): ("2024-02-28 22", "2024-02-29 06"), ("date", "nonsense"): None, ("date", None): None, ("number", "3"): None,
}


def test_meaning_of_dates_and_times(spark):
    rows = spark.createDataFrame(list(MEANT), "kind string, value string")
    got = calendar.with_meaning(rows, "kind", "value", F.lit(REFERENCE).cast("timestamp")).collect()
    short = lambda t: t and t[:13]
    for r in got:
        m, want = r["meant"], MEANT[r["kind"], r["value"]]
        assert (None if m is None else short(m["value"]) if m["kind"] == "InstantTime" else (short(m["from"]), short(m["to"]))) == want, r
    assert all(r["meant"] is None for r in calendar.with_meaning(rows, "kind", "value", F.lit(None).cast("timestamp")).collect())
    leap = spark.createDataFrame([("date", "february 29")], "kind string, value string")
    assert calendar.with_meaning(leap, "kind", "value", F.lit("2096-03-01").cast("timestamp")).first()["meant"]["value"].startswith("2104-02-29")


def test_meaning_follows_the_clock_of_the_session(spark):
    rows = spark.createDataFrame([("time", "3:30 am"), ("date", "tomorrow")], "kind string, value string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:  # the night on which clocks go forward
        got = [r["meant"]["value"] for r in calendar.with_meaning(rows, "kind", "value", F.lit("2024-03-30 22:00:00+00:00").cast("timestamp")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2024-03-31 03:30:00 +02:00", "2024-03-31 00:00:00 +01:00"]


def test_slots_resolve_to_instants(spark):
    slots = spark.createDataFrame([("datetime", "tomorrow at 5 pm", "x"), ("number", "twenty two", "x"), ("plant", "fern", "Fern"), ("duration", "2 hours and 5 minutes", "x")], "k string, r string, v string")
    got = [r["value"] for r in entities.resolved_values(slots, "k", "r", "v", reference=F.lit(REFERENCE).cast("timestamp")).collect()]
    assert got == ['{"kind":"InstantTime","value":"2024-02-29 17:00:00 +00:00","grain":"Hour","precision":"Exact"}', '{"kind":"Number","value":"22"}', '{"kind":"Custom","value":"Fern"}', '{"kind":"Duration","value":"125","unit":"minute"}']
