"""Arrow schema of a Spark schema text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema


def arrow_schema(text: str, spark: SparkSession) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], text).schema)
