import pytest


@pytest.fixture
def texts(spark):
    """A documents table of (doc_id, text) rows, over several partitions."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
