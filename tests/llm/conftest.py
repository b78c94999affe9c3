"""Documents with everything that may go wrong in a column."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row string, name string, raw string, size int"
ODD = ["", None, " \t\n", "one", "one two", "ONE two", "éè \U0001f600 x", "a" * 50_000, "word " * 30_000]


@pytest.fixture(scope="session")
def frame(spark):
    """Texts (or pairs of id and text) as documents with further columns whose names clash with inner ones."""
    def make(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None, "x", None, "n", "r", k) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, SCHEMA)
    return make


@pytest.fixture(scope="session")
def passages():
    """Texts that share passages, with near and exact copies, in a vocabulary small enough to repeat."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) for _ in range(400)]

    def text(n):
        return " ".join(draw.choice(words) for _ in range(n))

    shared = [text(n) for n in (8, 19, 20, 21, 35, 60, 120)]
    out = []
    for _ in range(120):
        parts = [text(draw.randint(0, 60)) for _ in range(draw.randint(1, 3))]
        if draw.random() < 0.7:
            parts.insert(draw.randint(0, len(parts)), draw.choice(shared))
        if draw.random() < 0.2:
            parts.append(parts[0])
        out.append(draw.choice([" ", "\n", "  "]).join(parts))
    for _ in range(60):
        copy = draw.choice(out).split(" ")
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        out.append(" ".join(copy))
    draw.shuffle(out)
    return out
