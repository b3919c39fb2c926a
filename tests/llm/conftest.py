import pytest

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper larch maple nutmeg oak pine quince rowan spruce teak willow yew".split()


def prose(seed: int, n: int) -> str:
    """n words that look like text, from a fixed recurrence."""
    out, x = [], seed * 7919 + 11
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 16 & 15] + WORDS[x >> 20 & 7])
    return " ".join(out)


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls in every column, an empty and a very long text, repeated rows, and columns whose names clash with
    those of the operators."""
    long = prose(3, 30_000)
    rows = [
        (1, prose(1, 120), "en", "src0", 5), (1, prose(1, 120), "en", "src0", 5), (2, prose(1, 120), "en", "src1", None), (3, "", "de", None, 0), (4, None, None, "src2", 0),
        (None, prose(2, 80), "fr", "src0", 1), (5, long, "en", "src0", len(long)), (6, " \n\t ", "en", "src3", 4), (7, "a", "es", "src3", 1), (8, "Zürich 　 naïve x <|endoftext|> 🙂", "en", "src4", 3),
    ]
    rows = [r + ("x", 1, True, 0.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, length long, kept boolean, score double")
