import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    from defectlens.llm.common import ready

    ready(spark)


@pytest.fixture
def table(spark):
    """A small table; every one of them also has columns with clashing names."""

    def make(rows, schema):
        wide = spark.createDataFrame(rows, schema)
        return wide.selectExpr("*", "'x' AS row", "7 AS n_words", "'y' AS k", "1 AS kept", "'z' AS t", "array(1) AS stack")

    return make
