import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids string, label string"


def _prose(rng, n, extra=()):
    words = ["the", "of", "and", "thonre", "Eau,", "été.", "ß", "中文", "it's", "x1", "1024", *extra]
    return " ".join(rng.choice(words) + (rng.choice("abcdef") * rng.randint(0, 3)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, nulls, odd white space and a very long text; ids as given."""
    rng = random.Random(7)
    base, passage = _prose(rng, 120), _prose(rng, 60)
    near = base.split()
    near[50] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n\x0b "), (7, "one two"), (8, "one two")]
    rows += [(i, f"{_prose(rng, 30)}\n{passage}\n{_prose(rng, 30)}") for i in range(10, 16)]
    rows += [(20, "line a\nline b\n\nline c\nline a\nline b"), (21, "x\nline a\nline b\r\nline b\nline a\n line b"), (22, "line b\n\n \nline c\nend")]
    rows += [(30, "<|endoftext|> a  b   c \n d e f \x1c g <|startoftext|>"), (31, "É" * 300 + " " * 50 + "'ll 'LL"), (32, _prose(rng, 9000))]
    rows += [(33, ("la " * 400).strip()), (34, "\U0001f600 é ẞ #*$%&|<>"), (None, base), (2, base), (40, " ".join([passage, passage]))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents with columns that clash with names the operators use."""
    rows = [(i, t, "en", None, len(t or ""), "mine", "mine", "mine") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
