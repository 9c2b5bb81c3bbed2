import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def build(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda rows: build(spark, rows)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def hard(spark):
    """Null and empty texts, null ids and sources, repeated rows, a long text, odd white space, clashing extra columns."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 400)}" for _ in range(60_000)) + " tail."
    body = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty one."
    rows = [(0, body), (1, body), (1, body), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, body), (None, None), (5, long), (6, long), (7, "É\u00a0ü\u2028x Ⅷ\n\n" + body), (8, "single"), (9, "a b c d"), (10, "a b c d"), (11, body.upper())]
    df = build(spark, [(*r, None if i % 4 == 0 else f"s{i % 3}") for i, r in enumerate(rows)])
    return df.selectExpr("*", "'x' as row", "1 as chunk", "2 as size", "'k' as key", "0 as shard", "1 as slot", "3 as h", "4 as source_size")
