import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, lang]) rows, with columns whose names clash with the operators' own."""
    def build(rows, **more):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1]), "x", 1)
                for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, rank string, blob int")

    return build
