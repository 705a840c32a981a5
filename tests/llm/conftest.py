"""Fixtures for the corpus operators; the session is tests/conftest.py's."""

import random

import pytest

#: Null and empty texts, blanks alone, ties, repeated texts, very long texts, characters of several bytes.
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "x " * 700), (904, "x " * 500), (905, "é" * 400), (906, "é" * 300), (907, "same text here"), (908, "same text here"), (909, "a" * 5000)]


def corpus(n=120, seed=1, vocabulary=60):
    """Documents that share passages of four base texts, with edits."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(vocabulary)}"
    bases = [[word() for _ in range(300)] for _ in range(4)]
    rows = []
    for i in range(n):
        base = list(bases[i % 4])
        if i % 3 == 0:
            for _ in range(rnd.randrange(4)):
                base[rnd.randrange(len(base))] = word()
            text = base
        else:
            a = rnd.randrange(200)
            text = [word() for _ in range(rnd.randrange(60))] + base[a : a + rnd.randrange(10, 120)] + [word() for _ in range(rnd.randrange(60))]
        rows.append((i, "\n".join(" ".join(text[j : j + 17]) for j in range(0, len(text), 17))))
    return rows + ODD


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """documents, with columns whose names clash with what operators make."""
    full = [(i, t, None if i % 11 == 0 else ("en", "fr")[i % 2], f"src{0 if i % 3 else i % 5}", len(t or ""), "clash", 7) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, route int").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")
