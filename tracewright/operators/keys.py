"""Signing keys: validation, trusted sets, validity windows, rotation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.hashing import key_fingerprint, key_id
from tracewright.functions.times import canonical_time_ok, format_time, parse_time
from tracewright.operators.joins import lookup_join

SCOPE = ["tenant_id", "project_id"]


def _set(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def key_error() -> Column:
    """Why a key record is not acceptable, or null."""
    lead = F.concat(F.lit("key "), F.coalesce("key_id", F.lit("")), F.lit(": "))
    out = (F.when(~F.col("algorithm").eqNullSafe("Ed25519"),
                  F.concat(lead, F.lit("unsupported algorithm "), F.coalesce("algorithm", F.lit(""))))
           .when(~F.octet_length("public_key").eqNullSafe(32), F.concat(lead, F.lit("public key must be 32 bytes")))
           .when(~F.col("key_id").eqNullSafe(key_id(F.col("public_key"))),
                 F.concat(F.lit("key id "), F.coalesce("key_id", F.lit("")),
                          F.lit(" does not match its public key (expected "), key_id(F.col("public_key")), F.lit(")")))
           .when(_set("fingerprint") & (F.col("fingerprint") != key_fingerprint(F.col("public_key"))),
                 F.concat(lead, F.lit("fingerprint does not match its public key"))))
    for name in ("activated_at", "retired_at", "revoked_at"):
        out = out.when(_set(name) & ~canonical_time_ok(F.col(name)),
                       F.concat(lead, F.lit("timestamp "), F.col(name), F.lit(" is not in canonical form")))
    return out


def split_keys(keys: DataFrame, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(trusted, rejected + reason). Equal copies count once; ids shared by
    different keys are dropped from the trusted set and reported."""
    scope = SCOPE if scope is None else scope
    place = F.struct("activated_at", "retired_at", "revoked_at", "public_key")
    columns = [c for c in keys.columns if c not in [*scope, "key_id"]]
    per_id = keys.withColumn("reason", key_error()).groupBy(*scope, "key_id").agg(
        F.array_distinct(F.collect_list("reason")).alias("reasons"),
        F.count_distinct(F.when(F.col("reason").isNull(), F.col("public_key"))).alias("variants"),
        F.max_by(F.struct(*columns), F.when(F.col("reason").isNull(), place)).alias("_row"))
    trusted = per_id.where("variants = 1").select(*scope, "key_id", *[F.col(f"_row.{c}").alias(c) for c in columns])
    clash = F.when(F.col("variants") > 1, F.array(F.lit("conflicting public keys share this id"))) \
        .otherwise(F.array().cast("array<string>"))
    rejected = per_id.select(*scope, "key_id", F.explode(F.concat("reasons", clash)).alias("reason"))
    return trusted, rejected


def conflicting_key_ids(keys: DataFrame) -> DataFrame:
    """Strict set building fails on these ids."""
    return keys.groupBy("key_id").agg(F.countDistinct("public_key").alias("variants")).where("variants > 1")


def key_usage(recorded_at: Column, skew_seconds: int, activated="activated_at", retired="retired_at",
              revoked="revoked_at") -> Column:
    """valid | before_activation | after_retirement | after_revocation at a canonical time."""
    at, skew = parse_time(recorded_at), F.expr(f"INTERVAL '{int(skew_seconds)}' SECOND")
    return (F.when(at > parse_time(F.col(revoked)) + skew, F.lit("after_revocation"))
            .when(at < parse_time(F.col(activated)) - skew, F.lit("before_activation"))
            .when(at > parse_time(F.col(retired)) + skew, F.lit("after_retirement"))
            .otherwise(F.lit("valid")))


def with_key(records: DataFrame, trusted: DataFrame, scope: list[str], key_scope: list[str],
             small: bool | None = None, skew_seconds: int = 300) -> DataFrame:
    """Records with the columns of their key, null if it is untrusted: key_public,
    key_activated_at, key_retired_at, key_revoked_at, and the last and first
    times (key_valid_*) a record may bear. The bounds are worked out per key, not per record."""
    skew = F.expr(f"INTERVAL '{int(skew_seconds)}' SECOND")
    side = trusted.select(
        *[F.col(k).alias(s) for k, s in zip(key_scope, scope)], "key_id", F.col("public_key").alias("key_public"),
        *[F.col(c).alias(f"key_{c}") for c in ("activated_at", "retired_at", "revoked_at")],
        format_time(parse_time(F.col("activated_at")) - skew).alias("key_valid_from"),
        format_time(parse_time(F.col("retired_at")) + skew).alias("key_valid_until"),
        format_time(parse_time(F.col("revoked_at")) + skew).alias("key_unrevoked_until"))
    return lookup_join(records, side, [*scope, "key_id"], spread="event_hash", small=small)


def rotation_timeline(keys: DataFrame) -> DataFrame:
    """Each key's window next to the start of the following one."""
    place = Window.partitionBy(*SCOPE).orderBy("activated_at", "key_id")   # keys of a project: a handful
    following = F.lead("activated_at").over(place)
    return keys.select(
        *SCOPE, "key_id", "status", "activated_at", "retired_at", following.alias("next_activated_at"),
        F.when(following.isNull(), F.lit("last"))
        .when(F.col("retired_at").isNull() | (F.col("retired_at") > following), F.lit("overlap"))
        .when(F.col("retired_at") < following, F.lit("gap")).otherwise(F.lit("contiguous")).alias("transition"))


def events_per_key(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Per project and key; a key id of another project is another key."""
    counts = events.groupBy(*SCOPE, "key_id").agg(F.count(F.lit(1)).alias("event_count"))
    return keys.join(counts, [*SCOPE, "key_id"], "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def newest_event_per_key(events: DataFrame) -> DataFrame:
    return events.groupBy(*SCOPE, "key_id").agg(F.max("recorded_at").alias("newest_recorded_at"))


def _new_key(at: Column) -> list[Column]:
    key = F.col("_public")
    return [*SCOPE, key_id(key).alias("key_id"), F.lit("Ed25519").alias("algorithm"), key.alias("public_key"),
            key_fingerprint(key).alias("fingerprint"), F.lit("active").alias("status"), at.alias("activated_at"),
            F.lit(None).cast("string").alias("retired_at"), F.lit(None).cast("string").alias("revoked_at")]


def close_key_window(keys: DataFrame, events: DataFrame, rotations: DataFrame) -> DataFrame:
    """Rotate the active keys of the projects in ``rotations`` (tenant_id, project_id, at, public_key; one row a project).

    An active key retires at the later of ``at`` and its newest event; the
    project's new key starts exactly there. Other projects are left alone.
    """
    asked = rotations.select(*SCOPE, F.col("at").alias("_at"), F.col("public_key").alias("_public"))
    joined = keys.join(newest_event_per_key(events), [*SCOPE, "key_id"], "left").join(asked, SCOPE, "left")
    active = (F.col("status") == "active") & F.col("_at").isNotNull()
    end = F.greatest("_at", F.coalesce("newest_recorded_at", "_at"))
    closed = joined.withColumn("retired_at", F.when(active, end).otherwise(F.col("retired_at"))) \
        .withColumn("status", F.when(active, F.lit("retired")).otherwise(F.col("status")))
    return closed.select(*keys.columns).unionByName(joined.where(active).select(*_new_key(end)).select(*keys.columns))


def revoke_key(keys: DataFrame, revocations: DataFrame) -> DataFrame:
    """Revoke the keys in ``revocations`` (tenant_id, project_id, key_id, at, public_key); where one was active, its
    project's replacement ``public_key`` starts at ``at``."""
    asked = revocations.select(*SCOPE, "key_id", F.col("at").alias("_at"), F.col("public_key").alias("_public"))
    joined = keys.join(asked, [*SCOPE, "key_id"], "left")
    hit = F.col("_at").isNotNull() & (F.col("status") != "revoked")
    changed = joined.select(*[
        F.when(hit, F.lit("revoked")).otherwise(F.col(c)).alias(c) if c == "status"
        else F.when(hit, F.col("_at")).otherwise(F.col(c)).alias(c) if c == "revoked_at"
        else F.when(hit, F.coalesce(F.col(c), "_at")).otherwise(F.col(c)).alias(c) if c == "retired_at"
        else F.col(c) for c in keys.columns])
    opened = joined.where(hit & (F.col("status") == "active")).select(*_new_key(F.col("_at")))
    return changed.unionByName(opened.select(*keys.columns))
