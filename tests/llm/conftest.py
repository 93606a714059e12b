import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and river stone quiet morning walked along bright garden window letter years before someone answered slowly".split(),
    "de": "der die und fluss stein ruhig morgen ging entlang hell garten fenster brief jahre bevor jemand langsam antwortete über".split(),
    "fr": "le la et rivière pierre calme matin marcha long clair jardin fenêtre lettre années avant quelqu'un répondit lentement où".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + (f"{rng.randrange(40)}" if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties, symbols."""
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, rng.randrange(3, 120)), lang, f"s{i % 3}", 10) for i, lang in enumerate(rng.choices(list(WORDS), k=60))]
    long = prose(rng, "en", 30_000)
    same = prose(rng, "de", 40)
    return [
        *rows, (100, None, None, None, None), (101, "", "en", None, 0), (102, "  \n\t ", None, "s0", 3), (103, long, "en", "s0", None), (104, same, "de", "s1", 5), (105, same, "de", "s1", 5),
        (105, same, "de", "s1", 5), (None, same, "de", None, 1), (106, "one", "en", "s", 3), (107, "ONE", "en", "s", 3), (108, "$$$ ### 123 \x00 \x1c", "fr", "s", 9), (109, "İé ß 日本語 text", None, "s", 9),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd documents, with extra columns named like results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.withColumns({"score": F.lit("x"), "n": F.lit(1), "sig": F.lit(2.0), "label": F.lit(None).cast("string"), "key": F.lit(True)})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(100, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
