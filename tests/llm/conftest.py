import pytest

from keepsake.session import fresh_path

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text, source) rows."""
    def build(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCUMENT)
    return build


@pytest.fixture(scope="session")
def folder_of(spark):
    """A table folder that holds the given tables."""
    def write(**tables):
        folder = fresh_path(spark, "fixture")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder
    return write
