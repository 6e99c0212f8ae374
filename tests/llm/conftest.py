import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """(rows) -> documents with an extra column whose name an operator might use itself."""
    def make(rows):
        return spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows],
                                     "doc_id long, text string, source string, size string, row_id int, score double")
    return make
