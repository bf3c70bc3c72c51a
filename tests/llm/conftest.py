import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows, with an extra column whose name clashes with what operators add."""

    def put(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "'x' as fp", "1 as n", "'y' as spans", "0 as held_out", "'z' as root", "7 as h", "8 as o", "'p' as lang_pred", "0.1 as lang_score", "9 as span_o", "'t' as told", "'k' as kept_row", "6 as count") if extra else df

    return put


#: Null, empty, blank, short, repeated, with marks of several kinds, and very long.
ODD = [(1, None), (2, ""), (3, " \n"), (4, "a"), (None, "no id here at all"), (5, "same row"), (5, "same row"), (6, "naïve 日本語 \U0001f600 <|endoftext|> x"), (7, "word " * 60_000), (8, "x" * 150_000)]
