import itertools

import pytest

LONG = "der lange Text, the long text. " * 4000


@pytest.fixture(scope="session")
def frame(spark, tmp_path_factory):
    """Rows as a written table, as the operators get them."""
    at, number = tmp_path_factory.mktemp("llm"), itertools.count()

    def make(rows, schema):
        path = str(at / f"t{next(number)}")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, doc string, row_id long, w string, hits string, fp long, "
          "digest string, score double, t string, base string, key long")
EXTRA = ("x", 7, "w", "h", 8, "d", 0.5, "t", "b", 9)


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    texts = [None, "", "  \n", "Hello the world", "Hello  the\tworld", LONG, LONG, "...", "écrit à Ünal@x.fr", "a@b.co 10.0.0.1 +1 (415) 555-2671"]
    rows = [(i, t, "en" if i % 2 else None, "s", None, *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, None, None, None, None, *[None] * 10), (None, "Hello the world", "en", None, 1, *EXTRA)]
    return frame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([], SCHEMA)
