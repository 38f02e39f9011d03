import pytest

DATA = "/root/testdata/sf0.001"
#: Columns that the operators use inside, and that a table may have as well.
CLASH = {"fp": "long", "h": "string", "mix_source": "string", "in_email": "int", "row": "string", "size": "int", "score": "string", "n_words": "string", "component_id": "long", "digest": "string", "gone": "int"}


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and clashing columns."""
    from pyspark.sql import functions as F

    passage = "the quick brown fox jumps over the lazy dog and runs home " * 6
    data = [
        (1, None, "en", "s"), (2, "", None, "s"), (3, " \n\t ", "en", None), (None, passage, None, None), (5, passage, "en", "s"), (5, passage, "en", "s"),
        (7, passage + "again", "de", "t"), (8, "é ñ \U0001f600 " * 40, "fr", "t"), (9, "word", "en", "s"), (10, "x" * 150_000, "en", "t"), (11, "a b " * 40_000, "en", "t"),
        (12, "mail me at a.b@c.example.org or 10.0.0.1, +1 (017) 555-7713, 4845168114407329", "en", "s"), (13, "<|im_end|> <\\|x|> #*$ under the MIT License", "en", "s"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("7").cast(t) for c, t in CLASH.items()})
