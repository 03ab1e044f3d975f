"""Inputs of the registered queries, all derived from the given tables.

The sealed chain, a tampered copy of it and the results of verifying both are
tables in a real deployment; here they are written once per session below the
checkpoint folder and read by every query that needs them.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.config import Tags
from tracewright.functions.crypto import public_key
from tracewright.functions.hashing import key_fingerprint, key_id
from tracewright.functions.times import format_time
from tracewright.operators.joins import lookup_join
from tracewright.plans.checkpointing import sign_checkpoints
from tracewright.plans.seal import seal, stream_heads
from tracewright.plans.verify import failure_sequences, verify_streams
from tracewright.schemas import CONTEXT_KEY, KEYS, STREAM_KEY
from tracewright.session import use_utc, written
from tracewright.sources.audit_view import PROJECT, TENANT, activity_events, conversation_events, order_requests, table
from tracewright.sources.sinks import record_run

TAGS = Tags()
ROTATED = "2024-01-15T00:00:00.000000Z"
SEED_A, SEED_B, SEED_C = (bytes(range(n, n + 32)) for n in (0, 32, 64))
PUBLIC = {name: public_key(seed) for name, seed in (("a", SEED_A), ("b", SEED_B), ("c", SEED_C))}
KEY = {name: "ed25519:" + hashlib.sha256(raw).hexdigest()[:32] for name, raw in PUBLIC.items()}
SEEDS = {KEY["a"]: SEED_A, KEY["b"]: SEED_B}
NOW = "2024-01-28T12:00:00.000000Z"

SCOPE = (TENANT, PROJECT)
#: Keys of the customers' projects: when they start, when some end early, when some are rotated.
KEYED, KEYED_EARLY, ROTATION = "1993-01-01T00:00:00.000000Z", "1992-06-01T00:00:00.000000Z", "1996-01-01T00:00:00.000000Z"

_MADE: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """Build a table once per session and input folder."""
    place = (spark.sparkContext.applicationId, sf_dir, name)
    if place not in _MADE:
        use_utc(spark)
        made = make()
        _MADE[place] = written(made, name) if isinstance(made, DataFrame) else made
    return _MADE[place]


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return table(spark, sf_dir, name)


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity as audit events, each with the key that was active at its time."""
    return activity_events(raw(spark, sf_dir, "events")).withColumn(
        "key_id", F.when(F.col("recorded_at") < ROTATED, F.lit(KEY["a"])).otherwise(F.lit(KEY["b"])))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "chain", lambda: seal(submitted(spark, sf_dir), SEEDS))


def short_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        view = conversation_events(raw(spark, sf_dir, "conversations"))
        return seal(view.withColumn("key_id", F.lit(KEY["a"])), SEEDS)
    return once(spark, sf_dir, "short_chains", make)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_requests(raw(spark, sf_dir, "orders"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "streams", lambda: stream_heads(chain(spark, sf_dir), checkpoints(spark, sf_dir)))


def keys(spark: SparkSession, kind: str = "good") -> DataFrame:
    """The project's keys; ``judged`` has a retired key, a revoked one and a forged record."""
    def row(name, status, activated, retired=None, revoked=None, fingerprint=None):
        return (TENANT, PROJECT, KEY[name], "Ed25519", bytearray(PUBLIC[name]),
                fingerprint or hashlib.sha256(PUBLIC[name]).hexdigest(), status, activated, retired, revoked)

    if kind == "good":
        rows = [row("a", "retired", "2023-12-01T00:00:00.000000Z", ROTATED), row("b", "active", ROTATED)]
    else:
        rows = [row("a", "retired", "2023-12-01T00:00:00.000000Z", "2024-01-10T00:00:00.000000Z"),
                row("b", "revoked", ROTATED, "2024-01-25T00:00:00.000000Z", "2024-01-25T00:00:00.000000Z"),
                row("c", "active", "2024-01-25T00:00:00.000000Z", fingerprint="f" * 64)]
    return spark.createDataFrame(rows, KEYS)


def _project(number) -> Column:
    return F.concat(F.lit("prj_"), F.lpad(number.cast("string"), 10, "0"))


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project per customer with an active key; a third of them have an older one that ended then or earlier."""
    customers = raw(spark, sf_dir, "customer").select("c_custkey")

    def of(rows: DataFrame, prefix: str, status: str, activated: str, retired: Column) -> DataFrame:
        public = F.unhex(F.sha2(F.concat(F.lit(prefix), F.col("c_custkey").cast("string")), 256))
        return rows.select(
            F.lit(TENANT).alias("tenant_id"), _project(F.col("c_custkey")).alias("project_id"), key_id(public).alias("key_id"),
            F.lit("Ed25519").alias("algorithm"), public.alias("public_key"), key_fingerprint(public).alias("fingerprint"),
            F.lit(status).alias("status"), F.lit(activated).alias("activated_at"), retired.alias("retired_at"), F.lit(None).cast("string").alias("revoked_at"))

    ended = F.when(F.col("c_custkey") % 2 == 0, F.lit(KEYED)).otherwise(F.lit(KEYED_EARLY))
    return of(customers, "key", "active", KEYED, F.lit(None).cast("string")).unionByName(
        of(customers.where("c_custkey % 3 = 0"), "old", "retired", "1992-01-01T00:00:00.000000Z", ended))


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new key for every customer's project."""
    return raw(spark, sf_dir, "customer").select(
        F.lit(TENANT).alias("tenant_id"), _project(F.col("c_custkey")).alias("project_id"), F.lit(ROTATION).alias("at"),
        F.unhex(F.sha2(F.concat(F.lit("new"), F.col("c_custkey").cast("string")), 256)).alias("public_key"))


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verification run per order, in seven projects; a quarter of them never ended."""
    n, at = F.col("o_orderkey"), format_time(F.col("o_orderdate").cast("timestamp_ntz"))
    return raw(spark, sf_dir, "orders").select(
        F.lit(TENANT).alias("tenant_id"), _project(F.col("o_custkey") % 7).alias("project_id"), F.concat(F.lit("vrf_"), n.cast("string")).alias("run_id"),
        F.when(n % 3 == 0, F.lit("stream")).when(n % 3 == 1, F.lit("project")).otherwise(F.lit("event")).alias("scope"),
        F.when(n % 5 == 0, F.lit("failed")).otherwise(F.lit("passed")).alias("status"), at.alias("started_at"),
        F.when(n % 4 > 0, at).alias("completed_at"), F.lit("").alias("report"))


def _checkpoint_bodies(events: DataFrame, every: int) -> DataFrame:
    return events.where(F.col("sequence") % every == 0).select(
        *STREAM_KEY, "sequence", F.col("event_hash").alias("head_hash"), F.col("recorded_at").alias("created_at"),
        F.concat(F.lit("chk_"), F.upper(F.substring(F.sha2("event_hash", 256), 1, 26))).alias("checkpoint_id"),
        F.lit(KEY["b"]).alias("key_id"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint at every 50th record."""
    return once(spark, sf_dir, "checkpoints", lambda: sign_checkpoints(
        _checkpoint_bodies(chain(spark, sf_dir), 50), SEEDS))


def _tampered(events: DataFrame, heads: DataFrame) -> DataFrame:
    """Mutations by sequence modulo 100, on all but the last three records of each stream."""
    ends = heads.select(*STREAM_KEY, (F.col("head_sequence") - 3).alias("last"))
    rows = lookup_join(events, ends, STREAM_KEY).where(F.col("sequence") <= F.col("last"))
    rows = rows.withColumn("r", F.col("sequence") % 100).where("r <> 37")
    for ctx, own in zip(CONTEXT_KEY, STREAM_KEY):
        rows = rows.withColumn(ctx, F.col(own))

    def change(column: str, r: int, value):
        nonlocal rows
        rows = rows.withColumn(column, F.when(F.col("r") == r, value).otherwise(F.col(column)))

    change("content", 3, F.replace("content", F.lit('"type":"user"'), F.lit('"type":"root"')))
    change("actor_id", 7, F.lit("user_x"))
    change("content", 11, F.concat(F.lit(" "), F.col("content")))
    change("recorded_at", 13, F.lit("2023-06-01T00:00:00.000000Z"))
    change("previous_hash", 17, F.repeat(F.lit("ab"), F.lit(32)))
    change("signature", 19, F.substring("signature", 1, 10))
    change("key_id", 23, F.concat(F.lit("ed25519:"), F.repeat(F.lit("0"), F.lit(32))))
    change("content", 29, F.lit(None).cast("string"))
    change("content", 31, F.lit("not json"))
    change("schema_version", 41, F.lit(2))
    change("recorded_at", 47, F.replace("recorded_at", F.lit("T"), F.lit(" ")))
    change("tenant_id", 59, F.lit("org_01OTHERTENANT00000000000"))
    swap = F.when((F.col("r") == 43) & (F.col("sequence") < F.col("last")), F.lit(1)) \
        .when(F.col("r") == 44, F.lit(-1)).otherwise(F.lit(0))
    rows = rows.withColumn("sequence", F.col("sequence") + swap)
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("r") == 53, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))))
    return rows.drop("r", "last", "_copy")


def tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "tampered", lambda: _tampered(chain(spark, sf_dir), streams(spark, sf_dir)))


def tampered_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of the untouched chain; at some the signature, at some the signed
    hash differs; one more at each original head, which the tampered chain lost."""
    def make():
        base = _checkpoint_bodies(chain(spark, sf_dir), 50)
        heads = streams(spark, sf_dir).where("head_sequence % 50 <> 0").select(
            *STREAM_KEY, F.col("head_sequence").alias("sequence"), "head_hash",
            F.col("head_recorded_at").alias("created_at"),
            F.concat(F.lit("chk_"), F.upper(F.substring(F.sha2("head_hash", 256), 1, 26))).alias("checkpoint_id"),
            F.lit(KEY["b"]).alias("key_id"))
        at = F.col("sequence") % 400
        forged = base.unionByName(heads).withColumn(
            "head_hash", F.when(at == 200, F.reverse("head_hash")).otherwise(F.col("head_hash")))
        return sign_checkpoints(forged, SEEDS).withColumn("signature", F.when(
            at == 100, F.reverse(F.hex("signature")).cast("binary")).otherwise(F.col("signature")))
    return once(spark, sf_dir, "tampered_checkpoints", make)


def tampered_verification(spark: SparkSession, sf_dir: str):
    return once(spark, sf_dir, "tampered_verification", lambda: verify_streams(
        tampered(spark, sf_dir), keys(spark, "judged"), streams=streams(spark, sf_dir),
        checkpoints=tampered_checkpoints(spark, sf_dir)).materialize())


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of verifying the tampered chain."""
    return once(spark, sf_dir, "findings", lambda: tampered_verification(spark, sf_dir).findings())


def clean_verification(spark: SparkSession, sf_dir: str):
    return once(spark, sf_dir, "clean_verification", lambda: verify_streams(
        chain(spark, sf_dir), keys(spark), streams=streams(spark, sf_dir),
        checkpoints=checkpoints(spark, sf_dir)).materialize())


def run_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two recorded runs: the clean chain, later the tampered one."""
    def make(part):
        def build():
            clean, bad = clean_verification(spark, sf_dir), tampered_verification(spark, sf_dir)
            first = record_run(clean.reports(), failure_sequences(clean), "vrf_1", "project", "schedule",
                               "2024-01-29T00:00:00.000000Z")
            second = record_run(bad.reports(), failure_sequences(bad), "vrf_2", "project", "api",
                                "2024-01-30T00:00:00.000000Z")
            return first[part].unionByName(second[part])
        return build
    return once(spark, sf_dir, "runs", make(0)), once(spark, sf_dir, "results", make(1))


