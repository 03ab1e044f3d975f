"""Append-only and write-once outputs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.config import ID_PATTERN, STREAM_PATTERN
from tracewright.functions.canon import json_string
from tracewright.functions.crypto import base64_text
from tracewright.schemas import STREAM_KEY


def append_events(events: DataFrame, path: str, max_rows_per_file: int = 5_000_000) -> None:
    """Append records, a directory per project and stream, in sequence order.

    Rows are spread by (stream, sequence range), so a stream that holds a third
    of all rows is written by many tasks; the order makes the files' min/max
    statistics useful for sequence ranges.
    """
    span = F.floor(F.col("sequence") / F.lit(max_rows_per_file))
    events.withColumn("_span", span).repartition(*STREAM_KEY, "_span") \
        .sortWithinPartitions(*STREAM_KEY, "sequence").drop("_span") \
        .write.mode("append").partitionBy("project_id", "stream") \
        .option("maxRecordsPerFile", max_rows_per_file).parquet(path)


def _text(name: str, column: str) -> Column:
    return F.concat(F.lit(f'"{name}":'), json_string(F.col(column)))


def _plain(name: str, column: str) -> Column:
    return F.concat(F.lit(f'"{name}":'), F.col(column).cast("string"))


def record_line(with_content: bool) -> Column:
    """A record as one line of JSON."""
    body = F.concat_ws(
        ",", _plain("schemaVersion", "schema_version"), _text("tenantId", "tenant_id"), _text("projectId", "project_id"),
        _text("stream", "stream"), _plain("sequence", "sequence"), _text("eventId", "event_id"),
        _text("recordedAt", "recorded_at"), _text("previousHash", "previous_hash"), _text("payloadHash", "payload_hash"),
        _text("keyId", "key_id"), _text("eventHash", "event_hash"),
        F.concat(F.lit('"signature":"'), base64_text("signature"), F.lit('"')),
        *([F.when(F.length("content") > 0, F.concat(F.lit('"content":'), F.col("content")))] if with_content else []))
    return F.concat(F.lit("{"), body, F.lit("}"))


def checkpoint_line() -> Column:
    body = F.concat_ws(
        ",", _plain("schemaVersion", "schema_version"), _text("checkpointId", "checkpoint_id"),
        _text("tenantId", "tenant_id"), _text("projectId", "project_id"), _text("stream", "stream"),
        _plain("sequence", "sequence"), _text("headHash", "head_hash"), _text("createdAt", "created_at"),
        _text("keyId", "key_id"), _text("checkpointHash", "checkpoint_hash"),
        F.concat(F.lit('"signature":"'), base64_text("signature"), F.lit('"')))
    return F.concat(F.lit("{"), body, F.lit("}"))


def key_line() -> Column:
    optional = [F.when(F.coalesce(F.col(c), F.lit("")) != "", _text(n, c)) for n, c in (
        ("tenantId", "tenant_id"), ("projectId", "project_id"), ("status", "status"), ("activatedAt", "activated_at"),
        ("retiredAt", "retired_at"), ("revokedAt", "revoked_at"))]
    body = F.concat_ws(",", _text("keyId", "key_id"), _text("algorithm", "algorithm"),
                       F.concat(F.lit('"publicKey":"'), base64_text("public_key"), F.lit('"')),
                       _text("fingerprint", "fingerprint"), *optional)
    return F.concat(F.lit("{"), body, F.lit("}"))


def anchor_checkpoints(checkpoints: DataFrame, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Publish checkpoints write-once below tenant/project/stream; return receipts.

    A checkpoint already there, also one that the same call brings twice, is left
    alone and reported as failed, as is one whose identifiers are not safe in a path.
    """
    spark = checkpoints.sparkSession
    if existing is None:
        try:
            existing = spark.read.schema("entry string, tenant_id string, project_id string, stream string").parquet(path)
        except Exception as err:  # noqa: BLE001 - the folder does not exist yet
            if "PATH_NOT_FOUND" not in str(err):
                raise
            existing = spark.createDataFrame([], "entry string, tenant_id string, project_id string, stream string")
    entry = F.format_string("%012d-%s", F.col("sequence"), F.col("checkpoint_id"))
    safe = F.col("tenant_id").rlike(ID_PATTERN) & F.col("project_id").rlike(ID_PATTERN) \
        & F.col("stream").rlike(STREAM_PATTERN) & F.col("checkpoint_id").rlike(ID_PATTERN)
    named = checkpoints.withColumn("entry", entry).withColumn("safe", safe)
    keys = [*STREAM_KEY, "entry"]
    there = existing.select(*keys).distinct().withColumn("there", F.lit(True))
    # copies of one checkpoint inside the batch: the first by its text is anchored, the others find it there
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in ("checkpoint_hash", "head_hash", "created_at") if c in checkpoints.columns]))
    judged = named.withColumn("copy", copy).join(there, keys, "left").withColumn(
        "there", F.coalesce("there", F.col("copy") > 1)).withColumn("status", F.when(
            F.col("safe") & ~F.col("there"), F.lit("anchored")).otherwise(F.lit("failed"))).withColumn(
        "error", F.when(~F.col("safe"), F.lit("identifiers are not fit for a path"))
        .when(F.col("there"), F.lit("there is one already")))
    from tracewright.session import durable
    judged = durable(judged)                      # decided once, before the write changes the answer
    judged.where("status = 'anchored'").select(*keys, checkpoint_line().alias("document")) \
        .write.mode("append").partitionBy(*STREAM_KEY).parquet(path)
    return judged.select("checkpoint_id", F.lit("file").alias("provider"), "status", F.when(
        F.col("status") == "anchored", F.concat_ws("/", *keys)).alias("receipt"), "error")


def record_run(reports: DataFrame, sequences: DataFrame | None, run_id: str, scope: str, trigger: str,
               started_at: str, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(run row per project, result row per stream). Event scope has no stream rows:
    checking an event does not establish the state of its stream."""
    from tracewright.schemas import CONTEXT_KEY
    project = CONTEXT_KEY[:2]
    named = {c: c.removeprefix("ctx_") for c in CONTEXT_KEY}
    run = reports.groupBy(*project).agg(
        F.count(F.lit(1)).alias("streams_checked"), F.sum("events_checked").alias("events_checked"),
        F.sum("failure_count").alias("failure_count")).withColumnsRenamed(named)
    if scope == "event":
        run = run.withColumn("streams_checked", F.lit(0).cast("long"))
    run = run.withColumns({"run_id": F.lit(run_id), "scope": F.lit(scope), "target": F.lit(target).cast("string"),
                           "trigger": F.lit(trigger), "started_at": F.lit(started_at), "completed_at": F.lit(started_at),
                           "status": F.when(F.col("failure_count") > 0, F.lit("failed")).otherwise(F.lit("passed"))})
    listed = reports if sequences is None else reports.join(sequences, CONTEXT_KEY, "left")
    empty = F.array().cast("array<bigint>")
    checked = F.col("events_checked") > 0
    first = F.col("first_failure.sequence")
    streams = listed.select(
        F.lit(run_id).alias("run_id"), *[F.col(c).alias(n) for c, n in named.items()], "valid", "events_checked",
        F.when(checked, F.col("first_sequence")).alias("first_sequence"),
        F.when(checked, F.col("last_sequence")).alias("last_sequence"), "failure_count",
        F.when(first > 0, first).alias("first_failure_sequence"),
        (empty if sequences is None else F.coalesce("failure_sequences", empty)).alias("failure_sequences"),
        F.col("first_failure.code").alias("first_failure_code"), F.lit(started_at).alias("completed_at"))
    return run, streams.where(F.lit(scope != "event"))
