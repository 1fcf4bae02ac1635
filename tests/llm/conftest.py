import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ODD_ROWS, SCHEMA


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from (doc_id, text) rows; sources go round."""

    def make(*rows):
        full = [(d, t, "en", f"s{i % 3}", len(t or "")) for i, (d, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names the operators use themselves."""
    table = spark.createDataFrame(ODD_ROWS, SCHEMA)
    for name in ("kept", "n_words", "component", "node", "key", "bucket", "size", "position", "blob", "found", "word"):
        table = table.withColumn(name, F.lit("clash"))
    return table


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
