"""Schemas of the stored documents and tables. Fixed, never inferred."""

from pyspark.sql import types as T

ANNOTATION = T.StructType(
    [
        T.StructField("imagePath", T.StringType()),
        T.StructField("imageWidth", T.IntegerType()),
        T.StructField("imageHeight", T.IntegerType()),
        T.StructField(
            "shapes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("shape_type", T.StringType()),
                        T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType()))),
                    ]
                )
            ),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)

OUTLINE = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("polygon", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("image", T.StringType()),
        T.StructField("json", T.StringType()),
        T.StructField("vehicle_zone", T.StringType()),
        T.StructField("zone_description", T.StringType()),
        T.StructField("zone_area", T.StringType()),
        T.StructField("total_defects", T.LongType()),
        T.StructField("defect_distribution", T.MapType(T.StringType(), T.LongType())),
        T.StructField("image_size", T.ArrayType(T.IntegerType())),
    ]
)

ANSWER = T.StructType(
    [
        T.StructField(
            "damages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("location", T.StringType()),
                        T.StructField("severity", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("summary", T.StringType()),
    ]
)

# Stored metric rows come in two layouts; both sets of fields are optional.
METRICS = T.StructType(
    [
        T.StructField("config", T.StringType()),
        T.StructField("total_cases", T.LongType()),
        T.StructField("num_cases", T.LongType()),
        T.StructField("successful_cases", T.LongType()),
        T.StructField("failed_cases", T.LongType()),
        T.StructField("avg_recall_at_k", T.DoubleType()),
        T.StructField("avg_retrieval_time_ms", T.DoubleType()),
        T.StructField("avg_generation_time_ms", T.DoubleType()),
    ]
)
