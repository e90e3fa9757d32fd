"""Detection over newly landed dataset files as a stream; its checkpoint replaces the progress file."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.spans import SPAN, detect


def detect_new(spark: SparkSession, dataset_path: str, out_path: str, checkpoint: str, schema) -> None:
    """Predictions of the rule detector for all files not seen before, then stop."""
    rows = spark.readStream.schema(schema).parquet(dataset_path)
    found = rows.select("uid", F.lit("presidio").alias("model"), detect(F.col("llm_input")).cast(f"array<{SPAN}>").alias("prediction"))
    query = found.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).partitionBy("model").trigger(availableNow=True).start()
    query.awaitTermination()
