import random

import pytest

#: Names that operators use for columns of their own, or might.
CLASHES = "size shard id runs copies _id _b _word _bits _runs _copy row row_number group_number gone word bits there turn key hi lo gram first a.b".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ",", "."]) for _ in range(n))


def corpus():
    """Documents with every awkward case: nulls, empty, repeated rows, ties, copies, long texts."""
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(1, 120)), rng.choice("abc")) for i in range(40)]
    rows += [(40 + i, prose(rng, 15) + " " + passage + " " + prose(rng, 20), "a") for i in range(6)]
    base = prose(rng, 150).split()
    for i in range(8):  # near copies
        own = list(base)
        for _ in range(i):
            own[rng.randrange(len(own))] = "changed"
        rows.append((50 + i, " ".join(own), "b"))
    rows += [(60 + i, rows[3][1], "c") for i in range(5)]  # exact copies
    rows += [(70, None, "a"), (71, "", None), (72, "   \n\t ", "a"), (73, "x", None), (74, "word " * 400, "b"), (75, "é" * 500 + "\n" + "é" * 500, "b"), (76, "<|endoftext|> & $$ # 中文 😀\n\nline\nline\n", "c"), (None, "null id text " * 30, "c")]
    rows += [rows[5], rows[5], rows[41]]  # repeated rows
    rows.append((80, prose(rng, 20000), "a"))
    return [(i, t, "en", s, 1, *["clash"] * len(CLASHES)) for i, t, s in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
