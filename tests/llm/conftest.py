import random

import pytest

WORDS = [a + b for a in ("ba", "ke", "lo", "mu", "ti") for b in ("ra", "sen", "tor", "wi", "xa", "zu")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, extras: nulls, empty and long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(5)
    passage = prose(rng, 120)
    base = [prose(rng, rng.randrange(3, 300)) for _ in range(40)]
    texts = [*base, None, "", " \n ", "a", "One two", "Ünï çode 漢字 🎉", base[3], base[3], prose(rng, 20000)]
    texts += [base[i] + " tail" for i in range(5)] + [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(4)]
    texts += ["Shti " * 400, "Released under the MIT License.", "x mit license y MIT LICENSE", "Licensed under CC BY-NC 4.0 and the Apache License, Version 2.0."]
    out = [(i * 3, t, "en", f"s{i % 3}", 7) for i, t in enumerate(texts)]
    out = [*out, (None, "null id " + base[1], "en", None, None), (9, base[4], None, "s", 1), out[2], out[2]]
    return [(*r, *OWN) for r in out]


#: Names that operators use, or have used, for columns of their own.
OWN = "_id _key _both _goes _idm _keym dk _doc _dk _spans _had sequence_id offset _block _home text_key node many part component size shared".split()
SCHEMA = "doc_id long, text string, lang string, row_number string, n int, " + ", ".join(f"{c} string" for c in OWN)


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Extra columns have names that the operators use inside."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
