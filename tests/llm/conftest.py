import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (id, text) pairs, with columns whose names clash with the operators' own."""
    from orelode.llm.common import ship

    ship(spark)

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)
        if not clash:
            return df
        from pyspark.sql import functions as F

        return df.withColumns({n: F.lit("x") for n in ("n_tokens", "score", "tails", "spans", "ids", "n_removed", "doc", "token", "key", "h1", "base", "a", "b")})

    return make


#: Nulls, empty and blank texts, ties, a repeated row, an id with two texts, a very long text.
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Ünïcode ▁ text 漢字 \U0001f600"), (6, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (8, "word " * 30_000), (9, "x"), (9, "a completely different text under the same id"), (None, "no id here at all, but a text"), (10, "z" * 50_000)]
