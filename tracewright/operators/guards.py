"""Constraint checks over tables: what a database trigger would have refused."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.config import HASH_PATTERN, KEY_ID_PATTERN, STREAM_PATTERN, ZERO_HASH
from tracewright.functions.times import canonical_time_ok
from tracewright.operators.joins import lookup_join
from tracewright.schemas import STREAM_KEY

# Row identifiers.
EVENT_ID = r"^evt_[0-9A-Z]{26}\z"
CHECKPOINT_ID = r"^chk_[0-9A-Z]{26}\z"


def _violations(df: DataFrame, keep: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in rules]))
    return df.select(*keep, F.explode(broken).alias("violation"))


def _first_violation(df: DataFrame, keep: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    first = F.coalesce(*[F.when(when, F.lit(name)) for name, when in rules])
    return df.select(*keep, first.alias("violation")).where("violation IS NOT NULL")


def link_guard(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New records must follow an existing or new record of their stream.

    Joined on (stream, sequence), which no hot stream can make uneven.
    """
    all_rows = new if existing is None else existing.unionByName(new)
    before = all_rows.select(*STREAM_KEY, (F.col("sequence") + 1).alias("sequence"),
                             F.col("event_hash").alias("_hash"), F.col("recorded_at").alias("_time"),
                             F.lit(True).alias("_there"))
    both = new.select(*STREAM_KEY, "sequence", "event_id", "previous_hash", "recorded_at") \
        .join(before, [*STREAM_KEY, "sequence"], "left")
    later = F.col("sequence") != 1
    return _first_violation(both, [*STREAM_KEY, "sequence", "event_id"], [
        ("genesis_not_zero", ~later & (F.col("previous_hash") != ZERO_HASH)),
        ("predecessor_missing", later & F.col("_there").isNull()),
        ("hash_mismatch", later & (F.col("_hash") != F.col("previous_hash"))),
        ("time_decreases", later & (F.col("recorded_at") < F.col("_time")))])


def head_guard(old: DataFrame, new: DataFrame, events: DataFrame) -> DataFrame:
    """Two snapshots of the stream registry: names stay, heads only move forward, onto an event."""
    was = old.select(*STREAM_KEY, F.col("head_sequence").alias("_seq"), F.col("head_hash").alias("_hash"),
                     F.col("last_checkpoint_sequence").alias("_cp"), F.lit(True).alias("_old"))
    now = new.select(*STREAM_KEY, "head_sequence", "head_hash", "last_checkpoint_sequence", F.lit(True).alias("_new"))
    both = was.join(now, STREAM_KEY, "full_outer")
    moved = both.where((F.col("head_sequence") != F.col("_seq")) | (F.col("head_hash") != F.col("_hash")))
    targets = moved.select(*STREAM_KEY, F.col("head_sequence").alias("sequence"), F.col("head_hash").alias("event_hash"))
    hit = lookup_join(events.select(*STREAM_KEY, "sequence", "event_hash"), targets.distinct(),
                      [*STREAM_KEY, "sequence", "event_hash"], "left_semi", spread="event_hash") \
        .select(*STREAM_KEY).distinct().withColumn("_hit", F.lit(True))
    out = both.join(hit, STREAM_KEY, "left")
    is_moved = (F.col("head_sequence") != F.col("_seq")) | (F.col("head_hash") != F.col("_hash"))
    return _first_violation(out, STREAM_KEY, [
        ("identity_changed", F.col("_new").isNull()),
        ("head_moves_backwards", F.col("head_sequence") < F.col("_seq")),
        ("head_without_event", is_moved & F.col("_hit").isNull()),
        ("checkpoint_moves_backwards", F.col("last_checkpoint_sequence") < F.col("_cp"))])


def dangling_heads(streams: DataFrame, events: DataFrame) -> DataFrame:
    """Heads that do not point at a record."""
    heads = streams.where("head_sequence > 0").select(
        *STREAM_KEY, F.col("head_sequence").alias("sequence"), F.col("head_hash").alias("event_hash"))
    return heads.join(events.select(*STREAM_KEY, "sequence", "event_hash"), [*STREAM_KEY, "sequence", "event_hash"], "left_anti")


def checkpoint_guard(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """Checkpoints that describe no record exactly."""
    wanted = checkpoints.withColumnRenamed("head_hash", "event_hash")
    return wanted.join(events.select(*STREAM_KEY, "sequence", "event_hash"),
                       [*STREAM_KEY, "sequence", "event_hash"], "left_anti").withColumnRenamed("event_hash", "head_hash")


def key_guard(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two snapshots of the keys: material is immutable, status only moves on, times are set once."""
    fixed = ["algorithm", "public_key", "fingerprint", "activated_at"]
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}") == F.col(f"n.{c}") for c in ("tenant_id", "project_id", "key_id")])
    both = old.alias("o").join(new.alias("n"), same, "left")
    differs = reduce(lambda a, b: a | b, [~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in fixed])
    o, n = F.col("o.status"), F.col("n.status")

    def reset(name: str) -> Column:
        return F.col(f"o.{name}").isNotNull() & ~F.col(f"o.{name}").eqNullSafe(F.col(f"n.{name}"))

    rules = [("key_missing", F.col("n.key_id").isNull()), ("material_changed", differs),
             ("revoked_key_reinstated", (o == "revoked") & (n != "revoked")),
             ("retired_key_reactivated", (o == "retired") & (n == "active")),
             ("retired_at_changed", reset("retired_at")), ("revoked_at_changed", reset("revoked_at"))]
    first = F.coalesce(*[F.when(when, F.lit(name)) for name, when in rules])
    return both.select("o.tenant_id", "o.project_id", F.col("o.key_id").alias("key_id"), first.alias("violation")).where("violation IS NOT NULL")


def append_only_guard(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old snapshot that are changed or gone in the new one."""
    columns = old.columns
    return old.select(*columns).exceptAll(new.select(*columns))


def event_checks(events: DataFrame) -> DataFrame:
    """Column rules of the event table, every violated rule per row."""
    def not_like(name: str, pattern: str) -> Column:
        return ~F.coalesce(F.col(name).rlike(pattern), F.lit(False))

    return _violations(events, [*STREAM_KEY, "sequence", "event_id"], [
        ("id", not_like("event_id", EVENT_ID)), ("sequence", ~F.coalesce(F.col("sequence") > 0, F.lit(False))),
        ("schema_version", ~F.col("schema_version").eqNullSafe(1)), ("stream", not_like("stream", STREAM_PATTERN)),
        ("actor", F.col("actor_type").isNull() | F.col("actor_id").isNull()), ("action", F.col("action").isNull()),
        ("recorded_at", ~canonical_time_ok(F.col("recorded_at"))), ("content", F.col("content").isNull()),
        ("payload_hash", not_like("payload_hash", HASH_PATTERN)),
        ("previous_hash", not_like("previous_hash", HASH_PATTERN)),
        ("event_hash", not_like("event_hash", HASH_PATTERN)), ("key_id", not_like("key_id", KEY_ID_PATTERN)),
        ("signature", ~F.octet_length("signature").eqNullSafe(64))])


def uniqueness(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Values that occur more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1") \
        .select(F.lit(name).alias("rule"), F.concat_ws("/", *columns).alias("value"), "copies")


def event_uniqueness(events: DataFrame) -> DataFrame:
    return uniqueness(events, ["event_id"], "id").unionByName(uniqueness(events, ["event_hash"], "event_hash")) \
        .unionByName(uniqueness(events, [*STREAM_KEY, "sequence"], "stream_sequence"))


def active_key_guard(keys: DataFrame) -> DataFrame:
    """Projects with more than one active key."""
    return uniqueness(keys.where("status = 'active'"), ["tenant_id", "project_id"], "one_active_key")
