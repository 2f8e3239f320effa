import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h1 long, line string, n int, pos int, key string, lost_id long"


def documents(spark, texts, langs=None, first=0):
    """Rows with doc_ids from first on, and extra columns whose names clash with the operators' own."""
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(first + i, t, lang, "s", len(t or ""), 1, 2, "x", 3, 4, "k", 5) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, repeated, near-equal, long, and odd characters."""
    rnd = random.Random(11)
    words = ["alpha", "béta", "gamma", "delta's", "ζήτα", "x1", "42", "#tag", "&&", "the", "of"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = prose(150)
    long = "\n".join(prose(12) for _ in range(300))
    return [None, "", " \n\t ", "a", "THE Of", "x y z", "it's 'll '' 're\r\n  end  ", base, base, base.replace("gamma", "gemma", 1), prose(60) + "\n" + base[:500] + "\n" + prose(40), long, long + " tail", "😀 " * 30, "\0nul\0", "word " * 120]


@pytest.fixture
def docs(spark, odd_texts):
    return documents(spark, odd_texts)


@pytest.fixture
def empty(spark):
    return documents(spark, [])
