"""Queries that verify many streams check signatures: a forged one is a failure."""
from pyspark.sql import functions as F

from tracewright.suite import data, registry

SF = "/root/testdata/sf0.001"


def test_forged_signature_in_one_of_many_streams(spark, monkeypatch):
    chain = data.short_chains(spark, SF)
    assert chain.filter("signature IS NULL").count() == 0
    one = chain.orderBy("stream", "sequence").first()
    hit = (F.col("stream") == one["stream"]) & (F.col("sequence") == one["sequence"])
    forged = chain.withColumn("signature", F.when(hit, F.unhex(F.lit("01" * 64))).otherwise(F.col("signature")))
    monkeypatch.setattr(data, "short_chains", lambda *_: forged)
    r = registry.QUERIES["k03_verify_many_streams"](spark, SF).first()
    assert r.valid == r.streams - 1 and r.failures == 1
