"""The tamper matrix: every mutation is a stream of its own, all are verified together."""
import hashlib

import pytest
from pyspark.sql import functions as F

from tracewright.config import VerifyOptions
from tracewright.functions.crypto import public_key
from tracewright.plans.checkpointing import sign_checkpoints
from tracewright.plans.seal import link, number_and_clamp, seal, stream_heads
from tracewright.plans.verify import verify_events, verify_segment, verify_streams
from tracewright.schemas import CONTEXT_KEY, INDEX_COLUMNS, KEYS, STREAM_KEY
from tracewright.session import durable

TENANT, PROJECT = "org_01TESTTENANT00000000000", "prj_01TESTPROJECT0000000000"
SEED, OTHER = bytes(range(32)), bytes(range(50, 82))
PUB, OTHER_PUB = public_key(SEED), public_key(OTHER)
KID, OTHER_KID = ("ed25519:" + hashlib.sha256(p).hexdigest()[:32] for p in (PUB, OTHER_PUB))
BUCKET = 16          # streams of 60 records cross several bucket borders
OPTIONS = VerifyOptions(bucket_rows=BUCKET)

# stream: (first code, first sequence, number of failures or None)
EXPECTED = {
    "untouched": (None, None, 0),
    "content": ("payload_hash_mismatch", 37, 1),
    "indexed": ("indexed_field_mismatch", 20, 1),
    "spaced": ("payload_not_canonical", 5, 1),
    "later": ("event_hash_mismatch", 30, 1),
    "earlier": ("event_hash_mismatch", 30, 2),
    "deleted": ("sequence_gap", 51, 2),
    "swapped": ("previous_hash_mismatch", 40, 6),
    "relinked": ("previous_hash_mismatch", 33, 2),
    "unsigned": ("signature_invalid", 10, 1),
    "truncated_signature": ("signature_invalid", 10, 1),
    "renumbered": ("sequence_gap", 65, 3),
    "tail_removed": ("head_mismatch", 51, 1),
    "tail_and_head_removed": ("checkpoint_beyond_head", 55, 1),
    "checkpoint_altered": ("checkpoint_invalid", 55, 1),
    "head_hash": ("head_mismatch", 60, 1),
    "beyond_head": ("head_mismatch", 60, 1),
    "no_content": ("payload_missing", 1, 60),
    "no_events": ("head_mismatch", 3, 1),
    "wrong_schema": ("unsupported_schema_version", 12, 1),
    "moved_context": ("context_mismatch", 14, 2),
    "foreign_key": ("event_hash_mismatch", 15, 2),
    "not_an_event": ("payload_hash_mismatch", 22, 1),
    "genesis_link": ("previous_hash_mismatch", 18, 2),
    "witness": ("checkpoint_mismatch", 30, 1),
}


def keys(spark, rows=None):
    base = (TENANT, PROJECT, KID, "Ed25519", bytearray(PUB), hashlib.sha256(PUB).hexdigest(), "active",
            "2024-01-01T00:00:00.000000Z", None, None)
    return spark.createDataFrame(rows or [base], KEYS)


@pytest.fixture(scope="module")
def chain(spark):
    names = [n for n in EXPECTED if n != "no_events"]
    rows = spark.range(60).crossJoin(spark.createDataFrame([(n,) for n in names], "stream string")).select(
        F.lit(TENANT).alias("tenant_id"), F.lit(PROJECT).alias("project_id"), "stream", F.col("id").alias("arrival"),
        F.concat(F.lit("evt_"), F.upper(F.substring(F.sha2(F.concat_ws("/", "stream", F.col("id").cast("string")), 256), 1, 26))).alias("event_id"),
        F.date_format(F.make_timestamp_ntz(F.lit(2024), F.lit(3), F.lit(1), F.lit(8), F.lit(0), F.lit(0))
                      + F.make_dt_interval(secs=F.col("id")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("recorded_at"),
        F.lit(KID).alias("key_id"), F.format_string('{"action":"edit","actor":{"id":"user_%d","type":"user"},"data":{"n":%d}}',
                                                    F.col("id") % 5, F.col("id")).alias("content"),
        F.lit("user").alias("actor_type"), F.concat(F.lit("user_"), (F.col("id") % 5).cast("string")).alias("actor_id"),
        F.lit("edit").alias("action"))
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in INDEX_COLUMNS if c not in rows.columns})
    return durable(seal(rows, {KID: SEED}, bucket_rows=BUCKET))


@pytest.fixture(scope="module")
def checked(spark, chain):
    rows = chain
    for ctx, own in zip(CONTEXT_KEY, STREAM_KEY):
        rows = rows.withColumn(ctx, F.col(own))
    s, n = F.col("stream"), F.col("sequence")

    def change(stream, column, where, value):
        nonlocal rows
        rows = rows.withColumn(column, F.when((s == stream) & where, value).otherwise(F.col(column)))

    change("content", "content", n == 37, F.replace("content", F.lit("edit"), F.lit("edIt")))
    change("indexed", "actor_id", n == 20, F.lit("user_9"))
    change("spaced", "content", n == 5, F.concat(F.lit(" "), F.col("content")))
    change("later", "recorded_at", n == 30, F.replace("recorded_at", F.lit(".000000Z"), F.lit(".001000Z")))
    change("earlier", "recorded_at", n == 30, F.lit("2024-03-01T08:00:00.000000Z"))
    rows = rows.where(~((s == "deleted") & (n == 50)))
    change("relinked", "previous_hash", n == 33, F.repeat(F.lit("ab"), F.lit(32)))
    change("unsigned", "signature", n == 10, F.lit(bytearray(64)))
    change("truncated_signature", "signature", n == 10, F.substring("signature", 1, 63))
    rows = rows.where(~(s.isin("tail_removed", "tail_and_head_removed") & (n > 50)))
    change("no_content", "content", n > 0, F.lit(None).cast("string"))
    change("wrong_schema", "schema_version", n == 12, F.lit(2))
    change("moved_context", "tenant_id", n == 14, F.lit("org_01OTHER0000000000"))
    change("foreign_key", "key_id", n == 15, F.lit(OTHER_KID))
    change("not_an_event", "content", n == 22, F.lit('{"action":5}'))
    change("genesis_link", "previous_hash", n == 18, F.lit("0" * 64))
    moved = F.when((s == "swapped") & (n == 40), 41).when((s == "swapped") & (n == 41), 40) \
        .when((s == "renumbered") & (n == 60), 65).otherwise(n)
    rows = rows.withColumn("sequence", moved.cast("long"))
    heads = stream_heads(chain).drop("last_checkpoint_sequence", "head_recorded_at")
    at_50 = chain.where("stream = 'tail_and_head_removed' AND sequence = 50").select(
        *STREAM_KEY, F.col("sequence").alias("head_sequence"), F.col("event_hash").alias("head_hash"))
    before_last = chain.where("stream = 'beyond_head' AND sequence = 58").select(
        *STREAM_KEY, F.col("sequence").alias("head_sequence"), F.col("event_hash").alias("head_hash"))
    heads = heads.where("stream NOT IN ('tail_and_head_removed', 'beyond_head')").unionByName(at_50).unionByName(before_last) \
        .withColumn("head_hash", F.when(F.col("stream") == "head_hash", F.reverse("head_hash")).otherwise(F.col("head_hash"))) \
        .unionByName(spark.createDataFrame([(TENANT, PROJECT, "no_events", 3, "0" * 64)],
                                           "tenant_id string, project_id string, stream string, head_sequence long, head_hash string"))
    bodies = chain.where("sequence = 55 OR (sequence = 30 AND stream = 'witness')").select(
        *STREAM_KEY, "sequence", F.col("event_hash").alias("head_hash"), F.col("recorded_at").alias("created_at"),
        F.concat(F.lit("chk_"), F.substring("event_id", 5, 26)).alias("checkpoint_id"), F.lit(KID).alias("key_id")) \
        .where("stream <> 'tail_removed'") \
        .withColumn("head_hash", F.when((F.col("stream") == "witness") & (F.col("sequence") == 30), F.reverse("head_hash"))
                    .otherwise(F.col("head_hash")))
    signed = sign_checkpoints(bodies, {KID: SEED}).withColumn("head_hash", F.when(
        F.col("stream") == "checkpoint_altered", F.reverse("head_hash")).otherwise(F.col("head_hash")))
    return verify_streams(durable(rows), keys(spark), streams=heads, checkpoints=signed.where("stream <> 'witness'"),
                          witnesses=signed.where("stream = 'witness'"), options=OPTIONS).materialize()


def test_first_failures(checked):
    got = {r.ctx_stream: (r.first_failure.code if r.first_failure else None,
                          r.first_failure.sequence if r.first_failure else None, r.failure_count)
           for r in checked.reports().collect()}
    assert got == EXPECTED


def test_swapped_records_name_each_other(checked):
    messages = {r.sequence: r.message for r in checked.findings().where(
        "ctx_stream = 'swapped' AND code = 'previous_hash_mismatch'").collect()}
    assert set(messages) == {40, 41, 42}
    assert "that of sequence 40, not of 41" in messages[42]
    genesis = checked.findings().where("ctx_stream = 'genesis_link' AND code = 'previous_hash_mismatch'").first()
    assert "genesis value" in genesis.message
    witness = checked.findings().where("code = 'checkpoint_mismatch'").first()
    assert witness.message.startswith("witness checkpoint chk_")


def test_emission_order_within_a_record(checked):
    rows = checked.findings().where("ctx_stream = 'swapped' AND sequence = 41").orderBy("emission").collect()
    assert [r.code for r in rows] == ["previous_hash_mismatch", "event_hash_mismatch", "timestamp_regression"]


def test_cap_keeps_counting(checked):
    from dataclasses import replace
    capped = replace(checked, options=replace(checked.options, max_failures=10))
    row = capped.reports().where("ctx_stream = 'no_content'").first()
    assert row.failure_count == 60 and row.failures_truncated
    listed = capped.listed().where("ctx_stream = 'no_content'")
    assert [r.sequence for r in listed.orderBy("position").collect()] == list(range(1, 11))


def test_results_do_not_depend_on_partitions_or_buckets(spark, chain):
    rows = chain.withColumn("content", F.when(F.col("sequence") % 7 == 0, F.lit("{}")).otherwise(F.col("content"))) \
        .where("sequence % 13 <> 0 AND stream < 'f'")
    seen = set()
    for parts, bucket in ((1, 5), (4, 1000), (16, 16)):
        out = verify_streams(rows.repartition(parts), keys(spark), options=VerifyOptions(bucket_rows=bucket)).findings()
        seen.add(tuple(sorted((r.ctx_stream, r.sequence, r.code, r.message) for r in out.collect())))
    assert len(seen) == 1 and len(next(iter(seen))) > 50


def test_other_keys_and_windows(spark, chain):
    rows = chain.where("stream = 'untouched'")

    def run(key_rows, **options):
        return verify_streams(rows, keys(spark, key_rows), options=VerifyOptions(bucket_rows=BUCKET, **options))

    def key(kid=KID, pub=PUB, fp=None, retired=None, revoked=None):
        return (TENANT, PROJECT, kid, "Ed25519", bytearray(pub), fp or hashlib.sha256(pub).hexdigest(), "active",
                "2024-01-01T00:00:00.000000Z", retired, revoked)

    wrong = run([key(OTHER_KID, OTHER_PUB)]).reports().first()
    assert (wrong.first_failure.code, wrong.first_failure.sequence, wrong.failure_count) == ("unknown_signing_key", 1, 60)
    late = run([key(retired="2024-03-01T08:00:30.000000Z")], clock_skew_seconds=1).reports().first()
    assert late.valid and late.warning_count == 28
    revoked = run([key(revoked="2024-03-01T08:00:30.000000Z")], clock_skew_seconds=1).reports().first()
    assert (revoked.first_failure.code, revoked.first_failure.sequence) == ("signing_key_revoked", 33)
    # The default tolerance of five minutes covers the whole chain.
    assert run([key(revoked="2024-03-01T08:00:30.000000Z")]).reports().first().valid
    forged = run([key(fp="0" * 64)]).findings().orderBy("emission").first()
    assert forged.code == "signing_key_invalid" and forged.sequence == 0


def test_segments(spark, chain):
    rows = chain.where("stream = 'untouched'")
    anchor = rows.where("sequence = 20").select(
        *[F.col(k).alias(c) for k, c in zip(STREAM_KEY, CONTEXT_KEY)], F.col("sequence").alias("anchor_sequence"),
        F.col("event_hash").alias("anchor_hash"), F.lit("checkpoint").alias("anchor_description"))
    assert verify_segment(rows.where("sequence > 20"), keys(spark), anchor, options=OPTIONS).reports().first().valid
    wrong = verify_segment(rows.where("sequence > 20"), keys(spark), anchor.withColumn("anchor_hash", F.reverse("anchor_hash")), options=OPTIONS)
    assert [(r.code, r.sequence) for r in wrong.findings().collect()] == [("anchor_mismatch", 21)]
    middle = verify_streams(rows.where("sequence > 5"), keys(spark), options=OPTIONS).reports().first().first_failure
    assert (middle.code, middle.sequence) == ("sequence_gap", 6)


def test_single_events(spark, chain):
    rows = chain.where("stream = 'untouched' AND sequence <> 30").withColumn(
        "content", F.when(F.col("sequence") == 10, F.lit("{}")).otherwise(F.col("content")))
    targets = rows.where("sequence IN (1, 10, 11, 31, 60)")
    out = verify_events(targets, rows, keys(spark), streams=stream_heads(chain))
    by_id = {r.event_id: r.sequence for r in targets.collect()}
    got = {by_id[r.target_id]: (r.first_failure.code if r.first_failure else None, r.events_checked) for r in out.reports().collect()}
    # The altered neighbour of 11 is not its own finding: neighbours are checked without content.
    assert got == {1: (None, 2), 10: ("payload_hash_mismatch", 3), 11: (None, 3), 31: ("sequence_gap", 2), 60: (None, 2)}


def test_segmented_sealing_equals_one_walk(spark, chain):
    headers = chain.where("stream < 'd'")
    again = link(headers, None, VerifyOptions().tags, segment_rows=7)
    same = again.join(chain, [*STREAM_KEY, "sequence"]).where(
        (again.event_hash == chain.event_hash) & (again.previous_hash == chain.previous_hash))
    assert same.count() == headers.count() == again.count()


def test_numbering_continues_and_clamps(spark):
    schema = "tenant_id string, project_id string, stream string, event_id string, arrival long, recorded_at string"
    rows = [("t", "p", "a", f"e{i:03}", i, f"2024-01-01T00:00:{(i * 7) % 60:02}.000000Z") for i in range(100)]
    heads = spark.createDataFrame([("t", "p", "a", 10, "2024-01-01T00:00:30.000000Z")],
                                  "tenant_id string, project_id string, stream string, head_sequence long, head_recorded_at string")
    out = number_and_clamp(spark.createDataFrame(rows, schema), heads, bucket_rows=8).orderBy("arrival").collect()
    assert [r.sequence for r in out] == list(range(11, 111))
    newest, want = "2024-01-01T00:00:30.000000Z", []
    for row in rows:
        newest = max(newest, row[5])
        want.append(newest)
    assert [r.recorded_at for r in out] == want
