import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, wordless, short, long, repeated and tied rows."""
    long = " ".join(f"w{i % 997}x{i // 997}" for i in range(6000))
    near = " ".join(f"a{i}" for i in range(120))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "One"), (6, "one two"), (7, near), (8, near), (9, near.replace("a60", "b60")), (10, near.upper()),
        (11, long), (12, "pre " + long + " post"), (13, "é" * 500), (14, "é" * 500), (15, "x" * 1000), (16, "ab " * 400), (17, near + " " + " ".join(f"c{i}" for i in range(80))), (18, "\u00a0 \u3000"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with extra columns of clashing names, and rows without an id."""
    rows = [(i, t, None if i % 3 else "s", None if i % 4 else "en", len(t or ""), i, "k") for i, t in odd_rows] + [(None, "no id here", None, None, 0, 0, "k"), (None, None, None, None, None, 0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size int, kept string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
