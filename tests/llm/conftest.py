import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "ze", "ra") for b in ("st", "rn", "ll", "d", "x", "mp")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, size string, n_words string, key string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empty and very long texts, ties, exact, near and repeated rows, common lines and passages."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(60)]
    base = prose(rng, 120)
    passage = prose(rng, 60)
    texts += [base] * 4
    for k in range(12):  # near copies
        words = base.split()
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 10)}" for _ in range(6)]
    texts += ["same line here\nsecond line too\n" + prose(rng, 30) for _ in range(8)] + ["same line here\nsecond line too\nsame line here\nsecond line too"]
    texts += [None, "", " ", "\n\n", "12 34", "é", "Ünï cödé wörds änd möre", "a" * 500, "ab " * 400, prose(rng, 9000), "one", "one two three four"]
    rows = [(i, t, ["en", "de", None][i % 3], [f"s{i % 4}", None, "s0"][i % 3], None, "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "nobody owns this text at all", "en", None, 3, "x", "x", "x", "x", "x"), (5, "another text of the same id", "en", "s1", 3, "x", "x", "x", "x", "x")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def unique_docs(spark, corpus):
    return spark.createDataFrame([r for i, r in enumerate(corpus[:-4])], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
