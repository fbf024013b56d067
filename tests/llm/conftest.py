import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="session")
def words():
    return tokens


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): random prose with copies, near copies, nulls, blanks, long and repeated rows."""
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    rows = [(i, prose(rng.choice([3, 40, 120])), "en", f"s{0 if i % 3 else i % 5}") for i in range(150)]
    base = prose(200).split()
    for i in range(150, 185):
        copy = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "en", "s0"))
    rows += [(200 + i, prose(60) + " " + " ".join(base[:70]), "en", "s1") for i in range(12)]
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n\t ", "en", None), (303, "one two", "en", "s2"), (304, "One TWO", "en", "s2"), (305, "x" * 40_000, "en", "s2"), (306, prose(20_000), "en", "s2"), (None, base and " ".join(base), "en", "s0"), (303, "one two", "en", "s2"), (307, "école Éa  x", "fr", "s3")]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus, tmp_path_factory):
    """The corpus as a written table with an extra column of a clashing name."""
    path = f"file://{tmp_path_factory.mktemp('docs')}/d"
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1.0) for r in corpus], "doc_id long, text string, lang string, source string, n_chars long, score double")
    df.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, documents, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}/d"
    documents.limit(0).write.parquet(path)
    return spark.read.schema(documents.schema).parquet(path)
