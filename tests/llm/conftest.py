import random

import pytest

#: doc_id, text, lang, source: nulls in every column, empty and very long texts, ties, copies and repeated rows.
WORDS = "the of and thing ring other water stone river cloud light house table paper garden winter summer letter window forest".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "s", "ed", ".", ",")) for _ in range(n))


def corpus(n=60, seed=0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        rows.append((k, prose(rng, rng.randint(1, 160)).capitalize(), rng.choice(("en", "fr", None)), "src0" if k % 3 else None))
    long = prose(rng, 6000)
    base = rows[5][1]
    words = prose(rng, 120).split()
    rows += [
        (100, None, "en", "s"), (101, "", "en", "s"), (102, " \n\t ", None, "s"), (103, long, "en", "s"), (104, base, "en", "s"), (105, base.replace(" ", "  \n"), "en", "s"), (106, base, "en", "s"), (106, base, "en", "s"),
        (None, "A text of nobody that has some words in it", "en", "s"), (None, base, None, None), (107, " ".join(words), "en", "s"), (108, " ".join([*words[:-3], "x", "y", "z"]), "en", "s"), (109, " ".join(["q", *words[1:-6]]), "en", "s"),
        (110, "one two", "en", "s"), (111, "ONE two", "en", "s"), (112, "one two three", None, "s"), (113, "é ü ñ 漢字 \U0001f600 <|endoftext|> it's 'S don't", "fr", "s"), (114, "%%% ### |||", None, "s"), (115, "a " * 300, "en", "s"),
        (116, 'please set token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" in the file', "en", "s"), (117, "a\x0bb\x0cc\x00d\x1ce\xa0f", "en", "s"),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The corpus with columns named like those that operators make or return."""
    from pyspark.sql import functions as F

    names = ("digest", "shard", "n_rows", "block", "word", "length", "row_id", "sequence_id", "kept", "score", "component_id", "minima", "key", "row", "judged", "language", "upper_band", "n_words", "log_perplexity", "base_failed", "lang_pred", "ids", "_id", "n_chars", "held_out")
    return docs.select("*", *(F.lit("x").alias(n) for n in names))
