"""Awkward documents: nulls in every column, empty and very long texts, ties, repeated rows, names that clash."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: extra columns with names that operators use inside
CLASHING = "group blob key n row block bits id size keep language share shard bin slot score word pair cell vec count root u v lo hi __cuts __doc removed start".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed: int, n: int) -> str:
    """n words that only texts with this seed share."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 100003}x{seed}" for i in range(n))


def messy_rows():
    shared = passage(1, 70)
    texts = [
        None,
        "",
        "   \n\t ",
        "one",
        "one two three",
        shared,
        shared,
        "before it " + shared + " and after it some more",
        passage(2, 40) + " " + shared,
        "short text with ümläute, 漢字 and emoji 🎉 in it",
        passage(3, 30) + "\n" + passage(3, 30),
        "\x00\x01 control \x7f bytes",
        "x" * 50_000,
        passage(4, 20_000),
        passage(4, 20_000) + " tail",
        "Spam " * 300,
    ]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, shared, "en", None, 5), (None, None, None, None, None), (5, "another text under an id that is taken", "en", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    df = spark.createDataFrame(messy_rows(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
