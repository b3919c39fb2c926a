"""English number words, built from a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ((10**9, "billion"), (10**6, "million"), (10**3, "thousand"))


def words(n: int) -> str:
    """1060 is `one thousand and sixty`, 23 is `twenty-three`."""
    if n < 0:
        return "minus " + words(-n)
    if n < 20:
        return SMALL[n]
    if n < 100:
        return TENS[n // 10 - 2] + ("-" + SMALL[n % 10] if n % 10 else "")
    if n < 1000:
        return SMALL[n // 100] + " hundred" + (" and " + words(n % 100) if n % 100 else "")
    for size, name in SCALES:
        if n >= size:
            rest = n % size
            return f"{words(n // size)} {name}" + ((" and " if rest < 100 else ", ") + words(rest) if rest else "")
    raise AssertionError


def word_column(n: Column) -> Column:
    """The same for whole numbers from 0 to 9999 as a column; null beyond."""
    small = F.array(*[F.lit(w) for w in SMALL])
    tens = F.array(*[F.lit(w) for w in TENS])
    n = n.cast("int")
    pick = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    div = lambda a, b: F.floor(a / b).cast("int")

    def below_100(m: Column) -> Column:
        return F.when(m < 20, pick(small, m)).otherwise(F.concat(pick(tens, F.greatest(div(m, 10) - 2, F.lit(0))), F.when(m % 10 > 0, F.concat(F.lit("-"), pick(small, m % 10))).otherwise("")))

    def below_1000(m: Column) -> Column:
        head = F.concat(pick(small, div(m, 100)), F.lit(" hundred"))
        return F.when(m < 100, below_100(m)).otherwise(F.concat(head, F.when(m % 100 > 0, F.concat(F.lit(" and "), below_100(m % 100))).otherwise("")))

    rest = n % 1000
    thousands = F.concat(pick(small, F.least(div(n, 1000), F.lit(9))), F.lit(" thousand"))
    tail = F.when(rest == 0, "").when(rest < 100, F.concat(F.lit(" and "), below_100(rest))).otherwise(F.concat(F.lit(", "), below_1000(rest)))
    return F.when((n < 0) | (n > 9999), None).when(n < 1000, below_1000(rest)).otherwise(F.concat(thousands, tail))


def number_table(spark: SparkSession, upto: int = 100) -> DataFrame:
    """n and its words, for 0 <= n < upto <= 10000."""
    return spark.range(upto).select(F.col("id").alias("n"), word_column(F.col("id")).alias("words"))
