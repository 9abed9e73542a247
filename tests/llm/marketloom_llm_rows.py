"""Rows that the tests of this folder share."""

#: A column of each name that operators use for their own.
EXTRA = "size string, shard int, slot int, n int, set string, score string, tokens int, h int, words string, doc int"


def make(spark, rows, extra=True):
    """Documents from (doc_id, text), with columns whose names the operators use themselves."""
    schema = "doc_id long, text string" + (", " + EXTRA if extra else "")
    return spark.createDataFrame([(*r, *((None,) * 10 if extra else ())) for r in rows], schema)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}x" for _ in range(n))
