from __future__ import annotations

import random

import pytest

#: Extra columns whose names the operators use inside.
CLASHES = ["row", "size", "bucket", "name", "first", "component", "base", "spans", "w", "features", "_row", "owner", "text_a", "part"]


def make_docs(spark, rows, extra: bool = True):
    """documents from (doc_id, text, source), with extra columns of clashing names."""
    rows = [(i, t, "en", s, None if t is None else len(t), *([7] * len(CLASHES) if extra else [])) for i, t, s in rows]
    names = ", ".join(f"`{c}` int" for c in (CLASHES if extra else []))
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long{', ' * extra}{names}")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ka", "lo", "mi", "te", "su", "ra", "né", "vo"]) for _ in range(rng.randint(1, 4))) for _ in range(max(20, n // 2))]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    base = prose(2, 120)
    near = base.split()
    near[7] = "anders"
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", "b"), (5, base, "b"), (6, base, "a"), (7, " ".join(near), None), (8, long, "a"), (8, long, "a"),
        (9, "one", None), (None, base, "a"), (11, "line here\nline here\nline here", "c"), (12, "é" * 130 + " x " + "é" * 130, "c"), (13, "ab" * 200, "c"), (14, prose(3, 80), "a"), (15, "one two", "b"), (16, "One TWO", "b"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make_docs(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return make_docs(spark, [])
