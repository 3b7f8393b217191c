import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from prose import prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, copies, repeated rows, ties, extra columns with clashing names."""
    a, b, c = prose(120, 1), prose(60, 2), prose(3000, 3)
    rows = [
        (0, a, "en", "s1"), (1, a, "en", None), (2, a + " tail words here", "fr", "s2"), (3, None, "en", "s1"), (4, "", None, "s1"), (5, " \t\n ", "de", "s3"),
        (6, "Ünïcode ☂ \U0001f600\nline two of some length\nline two of some length", "de", "s3"), (7, "line TWO of some length \nshort\n", "de", "s3"), (8, b, "fr", "s2"), (8, b, "fr", "s2"), (9, c, "en", "s1"),
        (None, b + " x", "fr", "s2"), (None, None, None, None), (10, "one", "en", "s4"), (11, "one", "en", "s4"), (12, prose(40, 5) + " " + b, "fr", "s2"), (13, "x" * 5000, "en", "s1"), (14, "12 34 !?", "en", "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["n_lines", "n_dropped", "kept", "taken", "target", "size_", "n_shingles", "component_id", "score", "lang_pred", "n_words", "sequence_id"]
    from pyspark.sql import functions as F

    return df.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit(f"old {c}").alias(c) for c in clash])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
