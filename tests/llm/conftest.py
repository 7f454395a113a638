import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """make(rows) -> documents from (doc_id, text[, lang, source])."""

    def build(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # columns whose names the operators use themselves
            from pyspark.sql import functions as F

            for name in ("n", "cls", "size", "label", "token", "first", "key", "n_words", "host", "length", "chunk"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n words of invented text, different for each seed."""
    import random

    def build(seed, n):
        dice = random.Random(seed)
        return " ".join("".join(dice.choice("bcdfglmnprst") + dice.choice("aeiou") for _ in range(dice.randint(1, 4))) for _ in range(n))

    return build


#: Texts that every operator must take.
ODD = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "one two three four",
    "one two three four five",
    "Ünïcödé ßß ñ 漢字 🙂 \u00a0 \u2003 e\u0301",
    "a\x00b",
    "x" * 300_000,
    "word " * 60_000,
    "\n" * 5_000,
    "line of words here now\n" * 500,
]
