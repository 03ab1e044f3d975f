"""The flagship query."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.plans.verify import verify_streams
from tracewright.suite import data
from tracewright.suite.registry import query
from tracewright.suite.sql import WITH_AV


@query("flagship_tamper_and_verify", WITH_AV + """ SELECT stream, count(*) AS events_checked, 1 AS failure_count,
  'payload_hash_mismatch' AS first_failure_code, 37 AS first_failure_sequence, false AS valid FROM av GROUP BY stream""", longs="failure_count first_failure_sequence")
def tamper_and_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = data.chain(spark, sf_dir)
    altered = chain.withColumn("content", F.when(F.col("sequence") == 37, F.replace(
        "content", F.lit('"type":"user"'), F.lit('"type":"root"'))).otherwise(F.col("content")))
    reports = verify_streams(altered, data.keys(spark), streams=data.streams(spark, sf_dir)).reports()
    return reports.select(F.col("ctx_stream").alias("stream"), "events_checked", "failure_count",
                          F.col("first_failure.code").alias("first_failure_code"),
                          F.col("first_failure.sequence").alias("first_failure_sequence"), "valid")
