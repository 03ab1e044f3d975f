"""Audit views of raw activity tables: what a job submits for sealing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.functions.canon import json_string
from tracewright.functions.times import format_time
from tracewright.schemas import INDEX_COLUMNS

TENANT = "org_01AUDITTENANT00000000000"
PROJECT = "prj_01AUDITPROJECT0000000000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _context(df: DataFrame) -> DataFrame:
    return df.withColumns({"tenant_id": F.lit(TENANT), "project_id": F.lit(PROJECT)})


def activity_events(events: DataFrame) -> DataFrame:
    """One audit event per activity row; stream = kind of activity.

    The content is written in canonical form: members in order, no spaces.
    """
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    content = F.concat(F.lit('{"action":"'), F.col("event_type"), F.lit('","actor":{"id":"'), user,
                       F.lit('","type":"user"},"data":'), F.replace(F.col("props"), F.lit(" "), F.lit("")), F.lit("}"))
    ts = F.col("ts").cast("timestamp_ntz")
    out = _context(events).select(
        "tenant_id", "project_id", F.col("event_type").alias("stream"),
        F.concat(F.lit("evt_"), F.lpad(F.col("event_id").cast("string"), 26, "0")).alias("event_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"), format_time(ts).alias("recorded_at"),
        content.alias("content"), F.lit("user").alias("actor_type"), user.alias("actor_id"),
        F.col("event_type").alias("action"))
    return out.withColumns({c: F.lit(None).cast("string") for c in INDEX_COLUMNS if c not in out.columns})


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Many short streams: one per conversation, one event per turn."""
    content = F.concat(F.lit('{"action":"message","actor":{"id":'), json_string(F.col("role")),
                       F.lit(',"type":"role"},"data":'), json_string(F.col("text")), F.lit("}"))
    moment = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) \
        + F.make_dt_interval(mins=F.col("turn").cast("int"))
    out = _context(conversations).select(
        "tenant_id", "project_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("stream"),
        F.concat(F.lit("evt_"), F.lpad(F.concat(F.col("conv_id").cast("string"), F.lit("t"),
                                                F.col("turn").cast("string")), 26, "0")).alias("event_id"),
        F.col("turn").cast("long").alias("arrival"), format_time(moment).alias("recorded_at"), content.alias("content"),
        F.lit("role").alias("actor_type"), F.col("role").alias("actor_id"), F.lit("message").alias("action"))
    return out.withColumns({c: F.lit(None).cast("string") for c in INDEX_COLUMNS if c not in out.columns})


def order_requests(orders: DataFrame) -> DataFrame:
    """Requests with before/after states: each order of a customer against the
    customer's previous one. A customer has few orders, so the window is small."""
    from pyspark.sql import Window

    def state(key, status, priority, customer):
        return F.concat(F.lit('{"token": "tok-'), customer.cast("string"), F.lit('", "order": '), key.cast("string"),
                        F.lit(', "status": "'), status, F.lit('", "priority": "'), priority, F.lit('"}'))

    place = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    now = state(*[F.col(c) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")])
    body = F.concat(
        F.lit('{ "stream": "orders", "action": "order.updated", "actor": {"type": "customer", "id": "c'),
        F.col("o_custkey").cast("string"), F.lit('"}, "resource": {"id": "o'), F.col("o_orderkey").cast("string"),
        F.lit('", "type": "order"}, "before": '), F.coalesce(F.lag("state").over(place), F.lit("null")),
        F.lit(', "after": '), F.col("state"), F.lit("}"))
    return orders.withColumn("state", now).withColumn("before", F.lag("state").over(place)) \
        .select("o_orderkey", "o_custkey", F.col("before"), F.col("state").alias("after"), body.alias("body"))
