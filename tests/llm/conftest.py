import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session")
def ready(spark):
    from logquarry.llm.common import prepared
    return prepared(spark)


@pytest.fixture
def documents(ready):
    """documents({id: text}) or documents([(id, text), ...]) -> table with all columns."""
    def make(texts, lang="en", source="s"):
        rows = list(texts.items()) if isinstance(texts, dict) else list(texts)
        return ready.createDataFrame([(i, t, lang, source, len(t) if t is not None else None) for i, t in rows], DOCUMENTS)
    return make


@pytest.fixture
def labels(ready):
    return lambda rows: ready.createDataFrame(rows, LABELS)


@pytest.fixture
def odd(ready):
    """Nulls in every column, empty and white texts, a very long one, repeated rows and
    ids, characters beyond the basic plane, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, "the same few words stand here in this text and in that one too my friend", "en", "s", 70),
            (1, "the same few words stand here in this text and in that one too my friend", "en", "s", 70),
            (2, "the same few words stand here in this text and in that one too my friend", "en", "s", 70),
            (3, None, "en", "s", None), (4, "", None, None, 0), (5, " \t\n \r\n", "de", "s", 5),
            (None, "the same few words stand here in this text and in that one too my friend", "en", None, 70),
            (6, long, "en", "s", len(long)), (7, "\U0001F600 é\u0000 x\ny\ny\n\ny", "fr", None, 10),
            (1, "another text under an id that is taken already", "en", "s", 45)]
    extra = ready.createDataFrame(
        [(*r, 1, "x", 0.5, True, "u", 3, 4) for r in rows],
        T.StructType([*DOCUMENTS.fields, T.StructField("n_words", T.IntegerType()), T.StructField("token", T.StringType()),
                      T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType()),
                      T.StructField("drop", T.StringType()), T.StructField("n_lines", T.IntegerType()),
                      T.StructField("sid", T.IntegerType())]))
    return extra


@pytest.fixture
def prose():
    """prose(seed, n, vocabulary) -> a text of n words."""
    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"v{r.randrange(vocabulary)}" for _ in range(n))
    return make
