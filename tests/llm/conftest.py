from __future__ import annotations

import pytest

#: Awkward rows that every operator must take: nulls, blanks, repeats, one very long text, unusual white space.
AWKWARD = [
    (1, "One line that is long enough to count.\nAnother line that is long enough."),
    (2, "One line that is long enough to count.\nAnother line that is long enough."),
    (2, "One line that is long enough to count.\nAnother line that is long enough."),
    (3, None), (4, ""), (5, " \n\t\n  "), (6, "a"), (7, "tab\there  two   three\x0bvt nbsp em\x1cfs"),
    (8, "word " * 30_000), (9, "É中文 🙂 é ſecret Kelvin <|endoftext|> x\0y"), (None, "a row without an id but with words"), (10, "One line that is long enough to count!"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    clash = ["fp", "rank", "part", "row", "_t", "_w", "kept", "id", "shard", "spans", "score", "line_no", "key", "_key", "_row", "row_no", "_text"]
    return df.withColumns({c: F.lit("clash") for c in clash}).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
