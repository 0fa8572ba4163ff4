import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, vocabulary=None):
    vocabulary = vocabulary or ["the", "river", "runs", "past", "old", "houses", "and", "small", "gardens", "where", "people", "sit", "talk"]
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) * (rng.random() < 0.4) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Small documents with copies, near copies, blanks, nulls, odd white space, ties and a long text."""
    rng = random.Random(3)
    french = ["le", "fleuve", "coule", "devant", "vieilles", "maisons", "jardins", "où", "gens", "parlent", "près"]
    texts = [prose(rng, rng.randrange(1, 90), french if i % 3 == 1 else None) for i in range(60)]
    base = prose(rng, 120)
    texts += [base, base, base + " tail", base.upper(), " ".join(base.split()[:-4])]
    texts += [None, "", " \n\t ", "\x0b\x0c", "one", "a b c d", "Ünï çödé   spaces here too \x1c end", "x" * 5000, "12 34 ++", "\x00 \x00a"]
    texts += [prose(rng, 9000), "word " * 3000, "</s>[INST] ok [/INST]", "<|endoftext|> is text"]
    out = [(i * 3, t, ["en", "fr" if i < 60 else "en", None][i % 3], [None, "b", "a", "\U0001f600", "￿"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], out[5], (15, "another text of one id", "en", "a", 3), (None, "no id here", None, None, None), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Further columns named as what operators make or use inside."""
    from pyspark.sql import functions as F

    names = ["score", "size", "key", "bucket", "cls", "vec", "token", "part", "rank", "length", "kept", "Accepted", "secrets", "n", "root", "times"]
    return docs.withColumns({n: F.lit(-7) for n in names})


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)
