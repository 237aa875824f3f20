import pytest


@pytest.fixture
def table(spark):
    """A documents-like table of (doc_id, text) pairs with a column whose name clashes with added ones."""

    def make(rows, clash=None):
        kind = "doc_id bigint, text string" + (f", {clash} string" if clash else "")
        return spark.createDataFrame([(*r, "old") if clash else r for r in rows], kind)

    return make
