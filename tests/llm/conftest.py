"""Documents with everything that may be odd about a row."""

import pytest
from pyspark.sql import functions as F

CLASHING = (
    "row t base random runs tested lang_pred lang_score keys node component family chunk hashes bucket "
    "h grams digest member kept_id pattern score posterior shard bin offset length piece"
).split()


@pytest.fixture(scope="session")
def odd_rows():
    long_text = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, "  \n\t ", "fr", "b"),
        (5, "1234 5678 !!! ...", "de", "a"),
        (6, long_text, "en", "a"),
        (7, long_text, "en", None),
        (None, "Le chat est sur la table et le chien est dans la maison avec les enfants.", "fr", "c"),
        (None, None, None, None),
        (8, "Der Hund ist im Haus und die Katze ist auf dem Tisch mit dem Kind.", "de", "c"),
        (8, "Der Hund ist im Haus und die Katze ist auf dem Tisch mit dem Kind.", "de", "c"),
        (9, "x" * 200_000, "en", "a"),
        (10, "naïve café 漢字 😀 token = 'abcdefgh1234' \x00 end", "fr", "a"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(*r, None if r[1] is None else len(r[1])) for r in odd_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({name: F.lit(i) for i, name in enumerate(CLASHING)})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
