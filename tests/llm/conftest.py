"""Small documents with every awkward case, shared by the tests of this folder."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_2 string, __id string, component_id int, __lw_x int"


def document_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "été", "the", "of", "12", "x@y.zz", "zeta", "eta", "theta", "iota", "kappa", "日本"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", ","]) for _ in range(rng.randint(5, 160))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " tail", "", "   \t ", None, "one", "\n", "a\nb\n\na", "x" * 5000, " ".join(["long"] * 3000)]
    footer = "\nThis very footer stands below many of these documents on page 7"
    texts += [" ".join(rng.choice(words) for _ in range(60)) + footer.replace("7", str(i)) for i in range(4)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(t or ""), None, "k", 1, 2) for i, t in enumerate(texts)]
    return [*rows, (3, texts[3], "en", "a", 1, None, "k", 1, 2), (None, texts[0], None, None, None, None, "k", 1, 2)]


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], i % 5 != 0, i % 7 == 0) for i, r in enumerate(rows)], "doc_id long, q boolean, t boolean").selectExpr(
        "doc_id", "cast(q as int) AS quality", "cast(t as int) AS toxic"
    )
