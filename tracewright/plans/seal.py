"""Sealing: number, clamp, hash, link and sign prepared events.

A hash chain is sequential per stream by definition. Everything else is not,
so only narrow rows (two header pieces) pass through the sequential step; the
content is hashed before it and joined back, and signed, after it.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.config import BUCKET_ROWS, SCHEMA_VERSION, ZERO_HASH, Tags
from tracewright.functions.crypto import sign_hashes
from tracewright.functions.hashing import header_after_link, header_before_link, payload_hash
from tracewright.operators.ordered import newest_per_key, number_rows, running_max, spread_bucket
from tracewright.schemas import EVENTS, INDEX_COLUMNS, STREAM_KEY
from tracewright.session import durable

SEGMENT_ROWS = 20_000_000
#: Least signing tasks per core.
SIGNING_WAVES = 6
_LINKED = "tenant_id string, project_id string, stream string, sequence long, previous_hash string, event_hash string"


def number_and_clamp(prepared: DataFrame, heads: DataFrame | None = None, *, arrival: str = "arrival",
                     bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Sequence in arrival order after the head; recorded_at never decreases."""
    bucket = spread_bucket(prepared, F.col(arrival), bucket_rows)
    numbered = number_rows(prepared, STREAM_KEY, [F.col(arrival), F.col("event_id")], bucket, heads=heads)
    floors = None if heads is None else heads.select(*STREAM_KEY, F.col("head_recorded_at").alias("head_value"))
    return running_max(numbered, STREAM_KEY, "sequence", "recorded_at", "recorded_at", heads=floors,
                       bucket_rows=bucket_rows)


def link(headers: DataFrame, heads: DataFrame | None, tags: Tags, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """previous_hash and event_hash of numbered headers.

    One task walks one stream, in constant memory. A stream with more than
    ``segment_rows`` new rows is walked in several rounds; every round's result
    is checkpointed, so a lost executor costs one segment, not the stream.
    """
    rows = headers.select(*STREAM_KEY, "sequence", header_before_link().alias("before"),
                          header_after_link().alias("after"))
    start = None if heads is None else heads.where("head_sequence > 0").select(
        *STREAM_KEY, F.col("head_sequence").alias("sequence"), F.col("head_hash").alias("event_hash"))
    longest = headers.groupBy(*STREAM_KEY).agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0
    if longest <= segment_rows:
        return _walk(rows, start, tags)
    # Segments are cut at fixed sequences, the same for all streams: no join
    # against the hot stream key is needed.
    lowest, highest = headers.agg(F.min("sequence"), F.max("sequence")).first()
    done = None
    for low in range(lowest, highest + 1, segment_rows):
        part = rows.where(F.col("sequence").between(low, low + segment_rows - 1))
        walked = durable(_walk(part, start, tags))
        done = walked if done is None else done.unionByName(walked)
        ends = newest_per_key(walked.select(*STREAM_KEY, "sequence", "event_hash"), STREAM_KEY, ["sequence"])
        start = durable(ends if start is None else newest_per_key(start.unionByName(ends), STREAM_KEY, ["sequence"]))
    return done


def _walk(rows: DataFrame, start: DataFrame | None, tags: Tags) -> DataFrame:
    lead = tags.event.encode() + b"\0"
    steps = rows.withColumn("event_hash", F.lit(None).cast("string"))
    if start is not None:
        # A head is a row of its own in front of its stream: no join needed.
        steps = steps.unionByName(start, allowMissingColumns=True)

    def walk(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        sha256, stream, previous = hashlib.sha256, None, ZERO_HASH
        for batch in batches:
            # Streams are told apart by codes, a column at a time; only the texts that are hashed become Python objects.
            codes = [pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in STREAM_KEY]
            starts = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in codes])) + 1
            before, after, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("before", "after", "event_hash"))
            heads = np.flatnonzero(batch.column("before").is_null().to_numpy(zero_copy_only=False))
            prevs, hashes = [], []
            for a, b in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows]):
                name = tuple(batch.column(c)[a].as_py() for c in STREAM_KEY) if b > a else stream
                if name != stream:
                    stream, previous = name, ZERO_HASH
                for lower, upper, own in zip(before[a:b].tolist(), after[a:b].tolist(), known[a:b].tolist()):
                    if lower is None:
                        previous = own
                        continue
                    prevs.append(previous)
                    previous = sha256(lead + f"{lower}{previous}{upper}".encode()).hexdigest()
                    hashes.append(previous)
            own = batch.select([*STREAM_KEY, "sequence"])
            if len(heads):
                own = own.take(pa.array(np.delete(np.arange(batch.num_rows), heads), pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())],
                                             [*own.schema.names, "previous_hash", "event_hash"])

    return steps.repartition(*STREAM_KEY).sortWithinPartitions(*STREAM_KEY, "sequence").mapInArrow(walk, _LINKED)


def _signing_tasks(spark: SparkSession) -> int:
    return max(SIGNING_WAVES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def seal(prepared: DataFrame, seeds: dict[str, bytes] | None, *, heads: DataFrame | None = None,
         tags: Tags = Tags(), arrival: str = "arrival", bucket_rows: int = BUCKET_ROWS,
         segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Chain records of prepared events.

    ``prepared``: stream key, event_id, arrival (integer order), recorded_at
    (canonical text), key_id, content and the index columns. Event ids are unique
    and the input gives the same rows when read again: write it first when
    preparing it was costly. ``seeds`` maps key ids to Ed25519 seeds; None leaves
    the signature null.
    """
    # Numbering and linking take several shuffles, so they see narrow rows only,
    # kept once, durably. The content is read twice and shuffled once.
    narrow = prepared.select(*STREAM_KEY, arrival, "event_id", "recorded_at", "key_id",
                             payload_hash(F.col("content"), tags).alias("payload_hash"))
    rows = durable(number_and_clamp(narrow, heads, arrival=arrival, bucket_rows=bucket_rows)
                   .withColumn("schema_version", F.lit(SCHEMA_VERSION)))
    headers = rows.join(link(rows, heads, tags, segment_rows), [*STREAM_KEY, "sequence"])
    place = [*STREAM_KEY, arrival, "event_id"]
    if seeds is None:
        signed = headers.withColumn("signature", F.lit(None).cast("binary"))
    else:
        # Signing costs most: narrow rows in many even tasks of a fixed number, not in about one per core.
        signed = headers.repartition(_signing_tasks(prepared.sparkSession), *place).withColumn(
            "signature", sign_hashes(F.col("event_hash"), F.col("key_id"), seeds, tags.event_signature))
    return signed.join(prepared.select(*place, "content", *INDEX_COLUMNS), place).select(*EVENTS.fieldNames())


def stream_heads(events: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """Registry of streams: the newest record of each, and its last checkpoint."""
    heads = events.groupBy(*STREAM_KEY).agg(
        F.max_by(F.struct("sequence", "event_hash", "recorded_at"), "sequence").alias("_h")) \
        .select(*STREAM_KEY, F.col("_h.sequence").alias("head_sequence"), F.col("_h.event_hash").alias("head_hash"),
                F.col("_h.recorded_at").alias("head_recorded_at"))
    if checkpoints is None:
        return heads.withColumn("last_checkpoint_sequence", F.lit(0).cast("long"))
    last = checkpoints.groupBy(*STREAM_KEY).agg(F.max("sequence").alias("last_checkpoint_sequence"))
    return heads.join(last, STREAM_KEY, "left").fillna(0, ["last_checkpoint_sequence"])
