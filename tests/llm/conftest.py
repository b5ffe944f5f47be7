import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A table from rows, over several partitions."""
    def table(rows, schema, parts=4):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return table
