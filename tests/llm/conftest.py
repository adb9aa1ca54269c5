import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, score double, kept string"


def rows_of(pairs):
    """Documents with columns whose names the operators use inside."""
    return [(i, t, lang, s, None if t is None else len(t), "x", 1.0, "y") for i, t, lang, s in pairs]


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def pairs(words):
    """Texts with copies, near copies, shared passages, ties, repeated rows, nulls, empty and long ones."""
    r = random.Random(7)
    text = lambda n: "\n".join(" ".join(r.choice(words) for _ in range(min(12, n - k))) for k in range(0, n, 12))
    passage = text(50)
    out = [(i, text(r.randint(1, 120)), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])) for i in range(60)]
    base = text(100)
    out += [(100 + i, base.replace(words[3], words[4], i), "en", "hot") for i in range(12)]
    out += [(200 + i, base, "en", "hot") for i in range(8)]
    out += [(300 + i, text(20) + "\n" + passage + "\n" + text(9), "de", "hot") for i in range(10)]
    out += [(400, None, "en", "a"), (401, "", "en", "a"), (402, " \t\n", None, None), (403, "one two", "en", "b"), (404, "ONE two", "en", "b"), (405, text(3000), "en", "c"), (406, "12 34 !", "en", "c"), (407, "é😀 ▁x\0y\x0b", "de", "c")]
    return out + [out[0], out[0]]


@pytest.fixture(scope="session")
def docs(spark, pairs):
    return spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
