"""Counts of a whole text that quality rules and weak labellers look at."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.runtime import sliced

BLANKS = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique", "n_adjacent", "n_upper", "n_exclaims", "n_pipes", "n_digits", "n_stops", "n_plain", "n_runs")
#: Words that running text of a language is full of.
STOPS = {
    "en": "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ils son mais comme ou si leur y dont elle deux ces été aux même cette nous fait tout on",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde",
}
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    n, upto = 0, 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def counts(text: bytes) -> tuple[int, ...]:
    """The numbers of NAMES for one text in UTF-8. Words are runs of anything but space, \\t, \\n, \\v, \\f and \\r; code points are all
    bytes that begin one, so bytes that are no UTF-8 count too. Plain words are letters and what lies outside ASCII, but for marks at their ends."""
    words = text.split()
    points = len(text.translate(None, NOT_POINTS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return (
        len(words),
        points,
        sum(map(text.count, SYMBOLS_EACH)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        sum(map(bytes.__eq__, words, words[1:])),
        sum(1 for w in words if len(w) > 1 and w.isupper()),
        text.count(b"!"),
        text.count(b"|"),
        sum(map(text.count, DIGITS_EACH)),
        sum(map(STOP_SET.__contains__, words)),
        sum(1 for w in text.translate(AS_LETTERS).split() if w.strip(MARKS).isalpha()),
        sum(1 for _ in MARK_RUN.finditer(text)),
    )


NOT_POINTS = BLANKS + bytes(range(0x80, 0xC0))
AS_LETTERS = bytes(b if b < 0x80 else 0x61 for b in range(256))
MARK_RUN = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
MARKS = b".,;:?!'\"()"
STOP_SET = frozenset(w.encode() for words in STOPS.values() for w in words.split())
SYMBOLS_EACH = [bytes([b]) for b in SYMBOLS]
DIGITS_EACH = [bytes([b]) for b in b"0123456789"]


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the numbers of NAMES for every whole text; null and empty texts have zeros. A map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [counts(t or b"") for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *NAMES])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {SCHEMA}")


def shares() -> dict[str, Column]:
    """Ratios of those numbers; zero where a text has no words."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
        "unique": F.col("n_unique") / words,
        "adjacent": F.col("n_adjacent") / words,
        "upper": F.col("n_upper") / words,
        "exclaims": F.col("n_exclaims") / words,
        "pipes": F.col("n_pipes") / words,
        "digits": F.col("n_digits") / words,
        "stops": F.col("n_stops") / words,
        "plain": F.col("n_plain") / words,
        "mark_runs": F.col("n_runs") / words,
        "richness": F.col("n_unique") / F.sqrt(words),
    }
