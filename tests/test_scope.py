"""Reads of one project, limits, pages over odd times, idempotent batches."""
import pytest
from pyspark.sql import functions as F

from tracewright.operators import keys as key_ops, listing, stats
from tracewright.sources.sinks import anchor_checkpoints

A, B = ("org_a", "prj_1"), ("org_b", "prj_1")
EVENT = "tenant_id string, project_id string, stream string, sequence long, event_id string, recorded_at string"


@pytest.fixture(scope="module")
def two(spark):
    rows = [(*scope, "click", n, f"evt_{scope[0]}_{n:05d}", f"2024-01-{1 + n % 28:02d}T00:00:00.000000Z") for scope in (A, B) for n in range(1, 601)]
    return spark.createDataFrame(rows, EVENT)


def test_reads_do_not_mix_tenants(two):
    assert {r.tenant_id for r in listing.chain_page(two, A, "click", 10, 25).collect()} == {"org_a"}
    assert listing.chain_range(two, B, "click", 1, 5).count() == 5
    assert listing.filter_events(two, A, stream="click").count() == 600
    assert stats.sequence_range(two, A, "click", None, None).first().last_sequence == 600
    assert stats.events_today(two, B, "2024-01-28T12:00:00.000000Z").first()[0] == 21
    assert listing.stream_names(two, ("org_c", "prj_1")).count() == 0


@pytest.mark.parametrize("limit", [0, 501, 1000])
def test_wrong_limits_are_refused(two, limit):
    with pytest.raises(ValueError, match="limit"):
        listing.page_with_cursor(two, A, limit)


def test_the_largest_page(two):
    page = listing.page_with_cursor(two, A, 500).collect()
    assert len(page) == 500 and all(r.has_more for r in page) and [r.position for r in page if r.next_cursor] == [500]


def test_page_numbers_with_odd_times(spark):
    rows = [(*A, "s", n, f"evt_{n:05d}", None if n % 97 == 0 else "soon" if n % 89 == 0 else f"{1970 if n % 83 == 0 else 2024}-01-01T00:{n % 60:02d}:00.000000Z")
            for n in range(3000)]
    events = spark.createDataFrame(rows, EVENT).repartition(5)
    got = {r.event_id: r.position for r in listing.page_numbers(events, A, 25, slice_rows=100).collect()}
    order = sorted(rows, key=lambda r: (r[5] is not None, r[5] or "", r[4]), reverse=True)
    assert got == {r[4]: i + 1 for i, r in enumerate(order)}


def test_neighbours_stay_in_their_stream(two):
    r = listing.neighbours(two.where("sequence <> 5")).where("sequence = 4 AND tenant_id = 'org_a'").collect()
    assert len(r) == 1 and r[0].before_id == "evt_org_a_00003" and r[0].after_id is None


def test_all_due_streams_are_found(spark):
    rows = [(*A, f"s{i}", 100 + i, f"2024-01-01T00:00:00.{i:06d}Z", 0) for i in range(300)]
    streams = spark.createDataFrame(rows, "tenant_id string, project_id string, stream string, head_sequence long, head_recorded_at string, last_checkpoint_sequence long")
    assert listing.streams_needing_checkpoint(streams, 1, 3600, "2024-02-01T00:00:00.000000Z").count() == 300


def test_rotation_touches_the_named_project_only(spark):
    key = lambda scope, n: (*scope, f"k{n}", "Ed25519", bytes([n] * 32), "f", "active", "2024-01-01T00:00:00.000000Z", None, None)
    keys = spark.createDataFrame([key(A, 1), key(B, 2)], "tenant_id string, project_id string, key_id string, algorithm string, public_key binary, fingerprint string, "
                                 "status string, activated_at string, retired_at string, revoked_at string")
    events = spark.createDataFrame([(*A, "k1", "2024-03-01T00:00:00.000000Z"), (*B, "k1", "2025-01-01T00:00:00.000000Z")], "tenant_id string, project_id string, key_id string, recorded_at string")
    asked = spark.createDataFrame([(*A, "2024-02-01T00:00:00.000000Z", bytes([9] * 32))], "tenant_id string, project_id string, at string, public_key binary")
    out = {(r.tenant_id, r.status): (r.activated_at, r.retired_at) for r in key_ops.close_key_window(keys, events, asked).collect()}
    end = "2024-03-01T00:00:00.000000Z"
    assert out == {("org_a", "retired"): ("2024-01-01T00:00:00.000000Z", end), ("org_a", "active"): (end, None), ("org_b", "active"): ("2024-01-01T00:00:00.000000Z", None)}


def test_one_new_key_is_fresh_once(spark):
    rows = [("p", "k", "/v1", "h1", "r1"), ("p", "k", "/v1", "h1", "r2"), ("p", "k", "/v1", "h2", "r3"), ("p", None, "/v1", "h", "r4")]
    requests = spark.createDataFrame(rows, "project_id string, idempotency_key string, endpoint string, request_hash string, request_id string")
    known = requests.limit(0).select("project_id", "idempotency_key", "endpoint", "request_hash", F.array(F.lit("e")).alias("event_ids"), F.lit("").alias("expires_at"))
    out = {r.request_id: r.decision for r in listing.replay_decisions(requests, known, "2024-01-01").collect()}
    assert out == {"r1": "fresh", "r2": "replay", "r3": "conflict", "r4": "fresh"}
