import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from marketloom_llm_rows import make, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a long one, ties, repeated rows, other scripts, near copies and chains of them."""
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "a b c d"), (None, "a row without an id"), (None, None), (7, "ñandú 漢字 \x85 x\xa0y 😀 İ ß"), (7, "the same id with another text")]
    base = prose(rng, 120)
    rows += [(10 + i, base) for i in range(6)] + [(10, base)]
    for i in range(12):  # each differs from the last in one place
        words = base.split(" ")
        words[100 - 8 * i : 100 - 8 * i] = [f"new{i}"]
        base = " ".join(words)
        rows.append((30 + i, base))
    shared = prose(rng, 40)
    rows += [(50 + i, f"{prose(rng, 30)} {shared} {prose(rng, 25)}") for i in range(12)]
    rows += [(80, prose(rng, 6000)), (81, "line one\nline two\n" * 30), (82, "!!! ### $$$ " * 40), (83, "X" * 9000), (84, "<|endoftext|> a  b\r\n c"), (85, prose(rng, 60) + " Ünï ")]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return make(spark, odd_rows)


@pytest.fixture
def empty(spark):
    return make(spark, [])
