"""Signed checkpoints of stream heads."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.config import BUCKET_ROWS, SCHEMA_VERSION, ZERO_HASH, Tags
from tracewright.functions.crypto import sign_hashes
from tracewright.functions.hashing import checkpoint_hash
from tracewright.operators.listing import streams_needing_checkpoint
from tracewright.operators.ordered import with_previous
from tracewright.schemas import CHECKPOINTS, STREAM_KEY


def sign_checkpoints(bodies: DataFrame, seeds: dict[str, bytes], tags: Tags = Tags()) -> DataFrame:
    """Add schema_version, checkpoint_hash and signature to checkpoint bodies."""
    hashed = bodies.withColumn("schema_version", F.lit(SCHEMA_VERSION)) \
        .withColumn("checkpoint_hash", checkpoint_hash(tags))
    return hashed.withColumn("signature", sign_hashes(
        F.col("checkpoint_hash"), F.col("key_id"), seeds, tags.checkpoint_signature)).select(*CHECKPOINTS.fieldNames())


def checkpoint_streams(streams: DataFrame, existing: DataFrame, seeds: dict[str, bytes], key_id: str, now: str, *,
                       min_events: int, max_age_seconds: int, checkpoint_id: Column | None = None,
                       tags: Tags = Tags()) -> DataFrame:
    """New checkpoints of all streams that are due; one that exists at a sequence is kept."""
    due = streams_needing_checkpoint(streams, min_events, max_age_seconds, now)
    made = checkpoint_id if checkpoint_id is not None else F.concat(
        F.lit("chk_"), F.upper(F.substring(F.sha2(F.concat_ws("/", *STREAM_KEY, "head_sequence", "head_hash"), 256), 1, 26)))
    bodies = due.select(*STREAM_KEY, F.col("head_sequence").alias("sequence"), "head_hash", made.alias("checkpoint_id"),
                        F.lit(now).alias("created_at"), F.lit(key_id).alias("key_id"))
    fresh = bodies.join(existing.select(*STREAM_KEY, "sequence"), [*STREAM_KEY, "sequence"], "left_anti")
    return sign_checkpoints(fresh, seeds, tags)


def against_records(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """Each checkpoint with whether the record at its sequence has the hash it names."""
    records = events.select(*STREAM_KEY, "sequence", "event_hash")
    return checkpoints.select(*STREAM_KEY, "sequence", "head_hash").join(records, [*STREAM_KEY, "sequence"], "left") \
        .withColumn("matches", F.col("head_hash").eqNullSafe(F.col("event_hash")))


def newest_at_or_before(positions: DataFrame, checkpoints: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """For each row with a stream key and from_sequence: the newest checkpoint
    at or before from_sequence - 1, or genesis.

    Positions and checkpoints are put in one order per stream and the last
    checkpoint is carried along, bucket by bucket: no position meets more than
    the one checkpoint it is looking for.
    """
    side = checkpoints.select(*STREAM_KEY, "sequence", F.lit(1).alias("_kind"),
                              F.struct("sequence", "checkpoint_id", "head_hash").alias("cp"))
    # A position sorts before a checkpoint of the same number.
    rows = positions.withColumn("sequence", F.col("from_sequence")).withColumn("_kind", F.lit(0))
    both = rows.withColumn("_row", F.struct(*positions.columns)).select(*STREAM_KEY, "sequence", "_kind", "_row") \
        .unionByName(side, allowMissingColumns=True)
    found = with_previous(both, both.select(*STREAM_KEY, "sequence", "_kind", "cp"), STREAM_KEY, ["sequence", "_kind"],
                          ["sequence"], "cp", bucket_rows).where("_kind = 0")
    return found.select(
        *[F.col(f"_row.{c}").alias(c) for c in positions.columns],
        F.when(F.col("prev_cp").isNull(), F.lit("genesis")).otherwise(F.lit("checkpoint")).alias("anchor_type"),
        F.col("prev_cp.checkpoint_id").alias("anchor_checkpoint_id"),
        F.coalesce("prev_cp.sequence", F.lit(0)).cast("long").alias("anchor_sequence"),
        F.coalesce("prev_cp.head_hash", F.lit(ZERO_HASH)).alias("anchor_hash"))


def checkpoints_in_range(ranges: DataFrame, checkpoints: DataFrame, span: int = 100_000) -> DataFrame:
    """Checkpoints with anchor_sequence < sequence <= to_sequence of each range (stream key + both bounds).

    A range is cut into spans of sequences, so a range and a checkpoint only
    meet where they can match, and a hot stream is spread over its spans.
    """
    cut = ranges.withColumn("_span", F.explode(F.sequence(
        F.floor((F.col("anchor_sequence") + 1) / span), F.floor(F.greatest("to_sequence", F.col("anchor_sequence") + 1) / span))))
    return checkpoints.withColumn("_span", F.floor(F.col("sequence") / span)).join(cut, [*STREAM_KEY, "_span"]).where(
        (F.col("sequence") > F.col("anchor_sequence")) & (F.col("sequence") <= F.col("to_sequence"))).drop("_span")
