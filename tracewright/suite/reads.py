"""Scans, filters, joins, statistics, sorts and pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.config import INGEST
from tracewright.functions.canon import canonicalize
from tracewright.functions.times import format_time, window_bound
from tracewright.operators import listing, stats
from tracewright.operators.keys import conflicting_key_ids, key_usage, split_keys, with_key
from tracewright.plans import overview as view
from tracewright.plans.checkpointing import against_records, checkpoints_in_range, newest_at_or_before
from tracewright.plans.verify import scan_chain
from tracewright.schemas import STREAM_KEY
from tracewright.suite import data
from tracewright.suite.registry import query
from tracewright.suite.sql import CHAIN, FIRST_BAD, KEY_OF, HEADS, PRESENT, STAMP, WITH_AV

NOW = data.NOW
_DAY = NOW[:10]

# ---- scans -----------------------------------------------------------------


@query("s01_scan_chain", CHAIN + " SELECT stream, sequence, event_id, content, event_hash FROM chain WHERE stream = 'purchase'")
def s01(spark, sf):
    rows = scan_chain(data.chain(spark, sf).where("stream = 'purchase'"))
    return rows.select(F.col("ctx_stream").alias("stream"), "sequence", "event_id", "content", "event_hash")


@query("s02_chain_page", CHAIN + """ SELECT stream, sequence, event_hash FROM chain WHERE stream = 'click' AND sequence > 40
  ORDER BY sequence LIMIT 25""")
def s02(spark, sf):
    return listing.chain_page(data.chain(spark, sf), data.SCOPE, "click", 40, 25).select("stream", "sequence", "event_hash")


@query("s03_chain_range", CHAIN + " SELECT stream, sequence, event_hash FROM chain WHERE stream = 'view' AND sequence BETWEEN 21 AND 120")
def s03(spark, sf):
    return listing.chain_range(data.chain(spark, sf), data.SCOPE, "view", 21, 120).select("stream", "sequence", "event_hash")


@query("s04_events_by_ids", WITH_AV + """, ids AS (SELECT generate_subscripts(l, 1) - 1 AS position, unnest(l) AS event_id FROM
    (SELECT [ 'evt_' || lpad(CAST(x AS VARCHAR), 26, '0') FOR x IN [900, 17, 444, 99999999999, 3]] AS l))
  SELECT CAST(i.position AS INTEGER) AS position, a.event_id, a.stream, a.sequence FROM ids i JOIN av a USING (event_id)""")
def s04(spark, sf):
    wanted = ["evt_" + str(n).zfill(26) for n in (900, 17, 444, 99999999999, 3)]
    ids = spark.range(1).select(F.array(*map(F.lit, wanted)).alias("event_ids"))
    return listing.events_by_ids(data.chain(spark, sf), data.SCOPE, ids).select("position", "event_id", "stream", "sequence")


@query("s08_read_requests", """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS index,
  '{"action":"' || event_type || '","n":' || event_id || '}' AS event FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT user_id, NULL, '{"action":"' || event_type || '","n":' || event_id || '}' FROM events WHERE event_id % 2 = 1""")
def s08(spark, sf):
    # Batches per user of the even events, single requests of the odd ones.
    from tracewright.sources.readers import explode_requests
    event = F.concat(F.lit('{"action": "'), F.col("event_type"), F.lit('", "n": '), F.col("event_id").cast("string"), F.lit("}"))
    rows = data.raw(spark, sf, "events").withColumn("e", F.struct("event_id", event.alias("text")))
    batches = rows.where("event_id % 2 = 0").groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("l")).select(
        F.col("user_id").alias("line"), F.concat(F.lit('{"events": ['), F.array_join(F.transform("l", lambda e: e["text"]), ", "),
                                                 F.lit("]}")).alias("value"))
    singles = rows.where("event_id % 2 = 1").select(F.col("user_id").alias("line"), F.col("e.text").alias("value"))
    out = explode_requests(batches.unionByName(singles))
    return out.select(F.col("line").alias("user_id"), "index", canonicalize(F.col("body"), INGEST)["canonical"].alias("event"))


@query("s10_append_events", CHAIN + " SELECT stream, sequence, event_hash FROM chain")
def s10(spark, sf):
    from tracewright.session import checkpoint_root
    from tracewright.sources.readers import read_chain
    from tracewright.sources.sinks import append_events
    import uuid
    path = f"{checkpoint_root(spark)}/appended-{uuid.uuid4().hex}"
    events = data.chain(spark, sf)
    append_events(events.where("sequence <= 100"), path)
    append_events(events.where("sequence > 100"), path)
    return read_chain(spark, path, data.TENANT, data.PROJECT).select("stream", "sequence", "event_hash")


@query("s10_append_batches", CHAIN + " SELECT stream, sequence, event_hash FROM chain")
def s10_batches(spark, sf):
    """Two batches, each brought twice, and one that died before it was published."""
    from tracewright.schemas import EVENTS
    from tracewright.session import checkpoint_root
    from tracewright.sources import commits
    import uuid
    path = f"{checkpoint_root(spark)}/batches-{uuid.uuid4().hex}"
    events = data.chain(spark, sf)
    parts = {"first": events.where("sequence <= 100"), "rest": events.where("sequence > 100")}
    commits.stage(path, {"events": parts["first"]})
    for _ in range(2):
        for name, rows in parts.items():
            commits.append_batch(spark, path, name, rows)
    return commits.committed(spark, path, "events", EVENTS).select("stream", "sequence", "event_hash")


def _appended_runs(spark, sf) -> str:
    """Both recorded runs as commits: the first one died once before, the second is repeated."""
    from tracewright.session import checkpoint_root
    from tracewright.sources import commits
    import uuid

    def make():
        path = f"{checkpoint_root(spark)}/recorded-{uuid.uuid4().hex}"
        runs, results = data.run_tables(spark, sf)
        for name in ("vrf_1", "vrf_2", "vrf_2"):
            own = F.col("run_id") == name
            if name == "vrf_1":
                commits.stage(path, {"runs": runs.where(own)})
            commits.append_run(spark, path, runs.where(own), results.where(own), name)
        return path
    return data.once(spark, sf, "recorded", make)


_RUN_SQL = "WITH " + PRESENT + """, c AS (SELECT count(*) AS n FROM av), p AS (SELECT count(*) AS n FROM present)
  SELECT 'vrf_1' AS run_id, 'passed' AS status, (SELECT count(*) FROM heads) AS streams_checked, (SELECT n FROM c) AS events_checked
  UNION ALL SELECT 'vrf_2', 'failed', (SELECT count(*) FROM heads), (SELECT n FROM p)"""


@query("s14_append_runs", _RUN_SQL)
def s14_appended(spark, sf):
    from tracewright.sources import commits
    return commits.committed(spark, _appended_runs(spark, sf), "runs", data.run_tables(spark, sf)[0].schema).select("run_id", "status", "streams_checked", "events_checked")


@query("s14_append_results", "WITH " + PRESENT + ", " + FIRST_BAD + """ SELECT 'vrf_1' AS run_id, stream, true AS valid, head_sequence AS last_sequence FROM heads
  UNION ALL SELECT 'vrf_2', stream, false, last_sequence FROM first_bad""")
def s14_appended_results(spark, sf):
    from tracewright.sources import commits
    return commits.committed(spark, _appended_runs(spark, sf), "results", data.run_tables(spark, sf)[1].schema).select("run_id", "stream", "valid", "last_sequence")


@query("s14_record_run", "WITH " + PRESENT + f""", c AS (SELECT count(*) AS n FROM av), p AS (SELECT count(*) AS n FROM present)
  SELECT 'vrf_1' AS run_id, 'passed' AS status, (SELECT count(*) FROM heads) AS streams_checked, (SELECT n FROM c) AS events_checked
  UNION ALL SELECT 'vrf_2', 'failed', (SELECT count(*) FROM heads), (SELECT n FROM p)""")
def s14(spark, sf):
    return data.run_tables(spark, sf)[0].select("run_id", "status", "streams_checked", "events_checked")


@query("s14_record_stream_results", "WITH " + PRESENT + ", " + FIRST_BAD + """ SELECT 'vrf_1' AS run_id, stream, true AS valid, 1 AS first_sequence,
    head_sequence AS last_sequence, NULL AS first_failure_sequence FROM heads
  UNION ALL SELECT 'vrf_2', stream, false, 1, last_sequence, first_failure_sequence FROM first_bad""", longs="first_sequence first_failure_sequence")
def s14_streams(spark, sf):
    return data.run_tables(spark, sf)[1].select("run_id", "stream", "valid", "first_sequence", "last_sequence",
                                                "first_failure_sequence")


@query("s15_chain_records", CHAIN + """, e AS (SELECT stream, max(sequence) AS head_sequence, max_by(event_hash, sequence) AS head_hash
  FROM chain GROUP BY stream) SELECT stream, sequence, event_hash, head_sequence, head_hash,
  CASE WHEN sequence < head_sequence THEN sequence END AS next_after FROM chain JOIN e USING (stream)""")
def s15(spark, sf):
    return listing.chain_records(data.chain(spark, sf), data.streams(spark, sf), with_content=False).select(
        "stream", "sequence", "event_hash", "head_sequence", "head_hash", "next_after")


# ---- filters ---------------------------------------------------------------

@query("f01_filter_events", WITH_AV + " SELECT event_id, stream FROM av WHERE stream = 'click' AND actor_id = 'user_7' AND actor_type = 'user'")
def f01(spark, sf):
    return listing.filter_events(data.chain(spark, sf), data.SCOPE, stream="click", actor_id="user_7", actor_type="user").select("event_id", "stream")


@query("f02_action_prefix", WITH_AV + " SELECT event_id, action FROM av WHERE starts_with(action, 'p')")
def f02(spark, sf):
    return listing.filter_events(data.chain(spark, sf), data.SCOPE, action="p*").select("event_id", "action")


@query("f02_action_literal_metacharacters", WITH_AV + " SELECT event_id FROM av WHERE starts_with(action, '%_') OR action = 'pu%'")
def f02_literal(spark, sf):
    rows = data.chain(spark, sf)
    return listing.filter_events(rows, data.SCOPE, action="%_*").unionByName(listing.filter_events(rows, data.SCOPE, action="pu%")).select("event_id")


@query("f03_time_window", WITH_AV + """ SELECT event_id FROM av WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20 10:30:00'""")
def f03(spark, sf):
    return listing.filter_events(data.chain(spark, sf), data.SCOPE, since="2024-01-10", until="2024-01-20T12:30:00+02:00").select("event_id")


@query("f04_keyset_cursor", WITH_AV + f""" SELECT event_id FROM av WHERE (recorded_at, event_id) <
  ('2024-01-20T00:00:00.000000Z', 'evt_00000000000000000000000500')""")
def f04(spark, sf):
    return listing.before_cursor(data.chain(spark, sf), data.SCOPE, "2024-01-20T00:00:00.000000Z", "evt_00000000000000000000000500").select("event_id")


def _status_sql(select: str, where: str = "true") -> str:
    return "WITH " + PRESENT + ", " + FIRST_BAD + f""", st AS (SELECT a.*, CASE WHEN a.sequence > f.last_sequence THEN 'unverified'
      WHEN f.first_failure_sequence IS NOT NULL AND a.sequence >= f.first_failure_sequence THEN 'failed' ELSE 'verified' END AS status
      FROM av a JOIN first_bad f USING (stream)) SELECT {select} FROM st WHERE {where}"""


for _status in ("verified", "failed", "unverified"):
    @query(f"f05_status_{_status}", _status_sql("event_id, stream, sequence", f"status = '{_status}'"))
    def f05(spark, sf, status=_status):
        rows = listing.with_status(data.chain(spark, sf), data.run_tables(spark, sf)[1])
        return rows.where(F.col("status") == status).select("event_id", "stream", "sequence")


@query("f06_tenant_scope", WITH_AV + " SELECT 'own' AS tenant, count(*) AS visible FROM av UNION ALL SELECT 'other', 0 FROM av GROUP BY 1", longs="visible")
def f06(spark, sf):
    rows = data.chain(spark, sf)
    counts = [listing.of_tenant(rows, tenant, data.PROJECT).agg(F.lit(name).alias("tenant"), F.count(F.lit(1)).alias("visible"))
              for name, tenant in (("own", data.TENANT), ("other", "org_01OTHERTENANT00000000000"))]
    return counts[0].unionByName(counts[1])


@query("f08_disclosure_filter", WITH_AV + " SELECT event_id FROM av WHERE actor_id = 'user_3' AND action = 'view'")
def f08(spark, sf):
    from tracewright.plans.evidence import disclosure_filter
    return disclosure_filter(data.chain(spark, sf), {"actorId": "user_3", "action": "view"}).select("event_id")


@query("f10_validate_settings", """SELECT c_custkey AS project, CASE WHEN c_custkey % 5 = 1 THEN 'states are retained full or as diff'
  WHEN c_custkey % 5 = 2 THEN 'redaction is one of redact, remove, mask'
  WHEN c_custkey % 5 = 3 THEN 'redaction does not reach /other/' || c_custkey
  WHEN c_custkey % 5 = 4 THEN 'no usable redaction key: --' END AS error FROM customer""")
def f10(spark, sf):
    from tracewright.plans.prepare import settings_errors
    k = F.col("c_custkey")
    rows = data.raw(spark, sf, "customer").select(
        k.alias("project"), F.when(k % 5 == 1, F.lit("some")).otherwise(F.lit("full")).alias("retain_states"),
        F.when(k % 5 == 2, F.lit("drop")).otherwise(F.lit("mask")).alias("redact_mode"),
        F.array(F.lit("iban"), F.when(k % 5 == 4, F.lit("--")).otherwise(F.lit("Card-No"))).alias("redact_keys"),
        F.array(F.when(k % 5 == 3, F.concat(F.lit("/other/"), k.cast("string"))).otherwise(F.lit("/after/iban"))).alias("redact_paths"),
        F.lit(0).alias("max_event_bytes"))
    return settings_errors(rows).select("project", "error")


_IDEM = f"""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate::TIMESTAMP + INTERVAL 7 DAY, '{STAMP}') AS expires_at FROM orders)"""


@query("f11_live_records", _IDEM + " SELECT o_orderkey FROM r WHERE expires_at > '1996-06-01T00:00:00.000000Z'")
def f11(spark, sf):
    rows = data.raw(spark, sf, "orders").select("o_orderkey", format_time(
        F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '7' DAY")).alias("expires_at"))
    return listing.live(rows, "1996-06-01T00:00:00.000000Z").select("o_orderkey")


@query("f11_expire_exports", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND strftime(o_orderdate::TIMESTAMP + INTERVAL 7 DAY, '{STAMP}')
  < '1996-06-01T00:00:00.000000Z' THEN 'expired' WHEN o_orderstatus = 'O' THEN 'completed' ELSE 'failed' END AS status FROM orders""")
def f11_exports(spark, sf):
    rows = data.raw(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        format_time(F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '7' DAY")).alias("expires_at"))
    return listing.expire_exports(rows, "1996-06-01T00:00:00.000000Z").select("o_orderkey", "status")


# ---- joins -----------------------------------------------------------------

@query("j01_events_with_stream", CHAIN + """ SELECT c.event_id, c.stream, m.n AS head_sequence FROM chain c
  JOIN (SELECT stream, max(sequence) AS n FROM chain GROUP BY stream) m USING (stream)""")
def j01(spark, sf):
    from tracewright.operators.joins import lookup_join
    heads = data.streams(spark, sf).select(*STREAM_KEY, "head_sequence")
    return lookup_join(data.chain(spark, sf), heads, STREAM_KEY, "inner").select("event_id", "stream", "head_sequence")


@query("j01_lookup_join_salted", WITH_AV + " SELECT event_id, stream, max(sequence) OVER (PARTITION BY stream) AS head_sequence FROM av")
def j01_salted(spark, sf):
    # The same join when the side is too large to broadcast: salted.
    from tracewright.operators.joins import lookup_join
    heads = data.streams(spark, sf).select(*STREAM_KEY, "head_sequence")
    return lookup_join(data.chain(spark, sf), heads, STREAM_KEY, "inner", max_rows=2, salts=8).select("event_id", "stream", "head_sequence")


@query("j02_latest_verification", "WITH " + PRESENT + ", " + FIRST_BAD + """ SELECT stream, 'vrf_2' AS run_id, false AS valid,
  last_sequence, first_failure_sequence FROM first_bad""", longs="first_failure_sequence")
def j02(spark, sf):
    return listing.latest_verifications(data.run_tables(spark, sf)[1]).select("stream", "run_id", "valid", "last_sequence",
                                                                               "first_failure_sequence")


@query("j03_trusted_keys", WITH_AV + f" SELECT event_id, key_id = '{data.KEY['a']}' AS trusted FROM av")
def j03(spark, sf):
    trusted, _ = split_keys(data.keys(spark).where(F.col("key_id") == data.KEY["a"]))
    scope = ["tenant_id", "project_id"]
    return with_key(data.chain(spark, sf), trusted, scope, scope).select("event_id", F.col("key_public").isNotNull().alias("trusted"))


@query("j04_key_validity", WITH_AV + f""" SELECT event_id, CASE WHEN key_id = '{data.KEY['a']}' THEN
    CASE WHEN recorded_at > '2024-01-10T00:05:00.000000Z' THEN 'after_retirement' ELSE 'valid' END
  WHEN recorded_at > '2024-01-25T00:05:00.000000Z' THEN 'after_revocation' ELSE 'valid' END AS usage FROM av""")
def j04(spark, sf):
    trusted, _ = split_keys(data.keys(spark, "judged"))
    scope = ["tenant_id", "project_id"]
    return with_key(data.chain(spark, sf), trusted, scope, scope).select("event_id", key_usage(
        F.col("recorded_at"), 300, "key_activated_at", "key_retired_at", "key_revoked_at").alias("usage"))


@query("j05_checkpoint_against_record", WITH_AV + """ SELECT stream, sequence, sequence % 400 <> 200 AS matches FROM av
  WHERE sequence % 50 = 0 UNION ALL SELECT stream, sequence, sequence % 400 <> 200 FROM
  (SELECT stream, max(sequence) AS sequence FROM av GROUP BY stream) WHERE sequence % 50 > 0""")
def j05(spark, sf):
    return against_records(data.tampered_checkpoints(spark, sf), data.chain(spark, sf)).select("stream", "sequence", "matches")


@query("j06_anchor_as_of", WITH_AV + """ SELECT stream, sequence AS from_sequence,
  CASE WHEN (sequence - 1) >= 50 THEN 'checkpoint' ELSE 'genesis' END AS anchor_type,
  ((sequence - 1) // 50) * 50 AS anchor_sequence FROM av""")
def j06(spark, sf):
    wanted = data.chain(spark, sf).select(*STREAM_KEY, F.col("sequence").alias("from_sequence"))
    return newest_at_or_before(wanted, data.checkpoints(spark, sf), bucket_rows=512).select("stream", "from_sequence", "anchor_type", "anchor_sequence")


@query("j07_checkpoints_in_range", WITH_AV + """ SELECT a.stream, a.sequence AS to_sequence, c.sequence FROM av a JOIN av c
  ON c.stream = a.stream AND c.sequence % 50 = 0 AND c.sequence BETWEEN a.sequence - 79 AND a.sequence""")
def j07(spark, sf):
    ranges = data.chain(spark, sf).select(
        *STREAM_KEY, (F.col("sequence") - 80).alias("anchor_sequence"), F.col("sequence").alias("to_sequence"))
    return checkpoints_in_range(ranges, data.checkpoints(spark, sf), span=100).select("stream", "to_sequence", "sequence")


@query("j14_idempotent_replay", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'fresh' WHEN o_orderkey % 3 = 1 THEN 'replay'
  ELSE 'conflict' END AS decision FROM orders""")
def j14(spark, sf):
    orders = data.requests(spark, sf)
    hashed = orders.select("o_orderkey", F.lit(data.PROJECT).alias("project_id"), F.col("o_orderkey").cast("string").alias("idempotency_key"),
                           F.lit("/v1/events").alias("endpoint"), F.sha2("body", 256).alias("request_hash"))
    known = hashed.where("o_orderkey % 3 > 0").select(
        "project_id", "idempotency_key", "endpoint", F.when(F.col("o_orderkey") % 3 == 1, F.col("request_hash"))
        .otherwise(F.reverse("request_hash")).alias("request_hash"), F.array(F.lit("evt")).alias("event_ids"),
        F.lit("2024-02-01T00:00:00.000000Z").alias("expires_at"))
    return listing.replay_decisions(hashed, known, NOW).select("o_orderkey", "decision")


@query("j14_replay_in_one_batch", """SELECT o_orderkey, CASE WHEN row_number() OVER w = 1 THEN 'fresh'
  WHEN o_orderstatus = first_value(o_orderstatus) OVER w THEN 'replay' ELSE 'conflict' END AS decision FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 20, '0'))""")
def j14_batch(spark, sf):
    # One key per customer, all of them new: the first order is fresh, the others repeat it or differ.
    hashed = data.raw(spark, sf, "orders").select(
        "o_orderkey", F.lit(data.PROJECT).alias("project_id"), F.col("o_custkey").cast("string").alias("idempotency_key"),
        F.lit("/v1/events").alias("endpoint"), F.sha2("o_orderstatus", 256).alias("request_hash"),
        F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("request_id"))
    known = hashed.limit(0).select("project_id", "idempotency_key", "endpoint", "request_hash", F.array(F.lit("evt")).alias("event_ids"),
                                   F.lit("").alias("expires_at"))
    return listing.replay_decisions(hashed, known, NOW).select("o_orderkey", "decision")


# ---- statistics ------------------------------------------------------------

@query("a01_project_stats", "WITH " + HEADS + f""" SELECT sum(head_sequence) AS events_total, count(*) AS streams,
  count(*) FILTER (WHERE head_recorded_at >= '2024-01-21T12:00:00.000000Z') AS active_streams, max(head_recorded_at) AS last_event_at FROM heads""", longs="events_total")
def a01(spark, sf):
    return stats.project_stats(data.streams(spark, sf), NOW).drop("tenant_id", "project_id")


@query("a02_events_today", f"SELECT count(*) AS events_today FROM events WHERE ts >= TIMESTAMP '{_DAY}'")
def a02(spark, sf):
    return stats.events_today(data.chain(spark, sf), data.SCOPE, NOW)


@query("a03_events_per_day", f"""SELECT strftime(d.day, '%Y-%m-%d') AS day, count(e.event_id) AS events FROM
  (SELECT unnest(generate_series(DATE '2024-02-06' - 13, DATE '2024-02-06', INTERVAL 1 DAY)) AS day) d
  LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY 1""")
def a03(spark, sf):
    return stats.events_per_day(data.chain(spark, sf), data.SCOPE, "2024-02-06T08:00:00.000000Z", 14)


@query("a05_sequence_range", WITH_AV + """ SELECT min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM av
  WHERE stream = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'""")
def a05(spark, sf):
    return stats.sequence_range(data.chain(spark, sf), data.SCOPE, "click", "2024-01-05T00:00:00.000000Z", "2024-01-09T00:00:00.000000Z")


@query("a07_stream_limit", "SELECT count(DISTINCT conv_id) AS streams, count(DISTINCT conv_id) >= 1000 AS at_limit FROM conversations")
def a07(spark, sf):
    return stats.stream_limit(data.short_chains(spark, sf)).select("streams", "at_limit")


@query("a09_stream_health", "WITH " + HEADS + " SELECT 0 AS passing, count(*) AS failing, 0 AS unverified, 'failing' AS state FROM heads", longs="passing unverified")
def a09(spark, sf):
    return stats.stream_health(data.streams(spark, sf), data.run_tables(spark, sf)[1]).select("passing", "failing", "unverified", "state")


@query("a09_stream_health_before_failure", "WITH " + HEADS + " SELECT count(*) AS passing, 0 AS failing, 0 AS unverified, 'healthy' AS state FROM heads", longs="failing unverified")
def a09_healthy(spark, sf):
    return stats.stream_health(data.streams(spark, sf), data.run_tables(spark, sf)[1].where("run_id = 'vrf_1'")).select(
        "passing", "failing", "unverified", "state")


@query("a17_ingested_total", "SELECT count(*) AS ingested FROM events")
def a17(spark, sf):
    return stats.ingested_total(data.chain(spark, sf)).select("ingested")


#: A run per order, in seven projects.
_RUNS = """WITH runs AS (SELECT lpad(CAST(o_custkey % 7 AS VARCHAR), 10, '0') AS project, 'vrf_' || o_orderkey AS run_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'stream' WHEN 1 THEN 'project' ELSE 'event' END AS scope,
  CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'passed' END AS status, o_orderkey % 4 > 0 AS done,
  strftime(o_orderdate::TIMESTAMP, '""" + STAMP + """') AS started FROM orders)"""


@query("a17_runs_by_scope", _RUNS + " SELECT project, scope, status, count(*) AS runs FROM runs GROUP BY ALL")
def a17_runs(spark, sf):
    return stats.runs_by_scope(data.order_runs(spark, sf)).select(F.substring("project_id", 5, 10).alias("project"), "scope", "status", "runs")


# ---- sorts and pages -------------------------------------------------------

@query("l01_newest_page", WITH_AV + """ SELECT event_id, recorded_at, row_number() OVER (ORDER BY recorded_at DESC, event_id DESC) AS position,
  (SELECT count(*) FROM av) > 25 AS has_more FROM av ORDER BY recorded_at DESC, event_id DESC LIMIT 25""")
def l01(spark, sf):
    return listing.page_with_cursor(data.chain(spark, sf), data.SCOPE, 25).select("event_id", "recorded_at", "position", "has_more")


@query("l02_all_pages", WITH_AV + """ SELECT event_id, position, (position - 1) // 25 + 1 AS page FROM
  (SELECT event_id, row_number() OVER (ORDER BY recorded_at DESC, event_id DESC) AS position FROM av)""")
def l02(spark, sf):
    return listing.page_numbers(data.chain(spark, sf), data.SCOPE, 25, slice_rows=300).select("event_id", "position", "page")


@query("l03_streams_needing_checkpoint", "WITH " + HEADS + """ SELECT stream, head_sequence - last_checkpoint_sequence AS behind FROM heads
  WHERE head_sequence > last_checkpoint_sequence AND (head_sequence - last_checkpoint_sequence >= 20
    OR head_recorded_at <= '2024-02-01T11:00:00.000000Z')""")
def l03(spark, sf):
    return listing.streams_needing_checkpoint(data.streams(spark, sf), 20, 3600, "2024-02-01T12:00:00.000000Z").select("stream", "behind")


@query("l04_newest_runs", _RUNS + """ SELECT run_id, status FROM runs WHERE project = '0000000003'
  ORDER BY started DESC, run_id DESC LIMIT 50""")
def l04(spark, sf):
    return listing.newest_runs(data.order_runs(spark, sf), (data.TENANT, "prj_0000000003"), 50).select("run_id", "status")


@query("l05_latest_run", _RUNS + """ SELECT project, max_by(run_id, started || run_id) AS run_id FROM runs
  WHERE done AND scope <> 'event' GROUP BY project""")
def l05(spark, sf):
    return listing.latest_run(data.order_runs(spark, sf)).select(F.substring("project_id", 5, 10).alias("project"), "run_id")


@query("l06_keys_by_age", "SELECT " + KEY_OF.format("'old' || c_custkey") + """ AS key_id FROM customer WHERE c_custkey % 7 = 2 AND c_custkey % 3 = 0
  UNION ALL SELECT """ + KEY_OF.format("'key' || c_custkey") + " FROM customer WHERE c_custkey % 7 = 2")
def l06_keys(spark, sf):
    keys = data.customer_keys(spark, sf).withColumn("project_id", F.concat(F.lit("prj_"), F.lpad(
        (F.substring("project_id", 5, 10).cast("long") % 7).cast("string"), 10, "0")))
    return listing.list_keys(keys, (data.TENANT, "prj_0000000002")).select("key_id")


@query("l06_streams_by_name", "WITH " + PRESENT + ", " + FIRST_BAD + """ SELECT h.stream, h.head_sequence, 'failed' AS status,
  f.first_failure_sequence FROM heads h JOIN first_bad f USING (stream) ORDER BY h.stream""", longs="first_failure_sequence")
def l06(spark, sf):
    return listing.list_streams(data.streams(spark, sf), data.run_tables(spark, sf)[1], data.SCOPE).select(
        "stream", "head_sequence", "status", "first_failure_sequence")


@query("l07_recent_events", _status_sql("event_id, status", "true ORDER BY recorded_at DESC, event_id DESC LIMIT 8"))
def l07(spark, sf):
    return view.recent_events(data.chain(spark, sf), data.run_tables(spark, sf)[1], data.SCOPE).select("event_id", "status")


@query("u02_stream_names", "SELECT DISTINCT event_type AS stream FROM events ORDER BY stream")
def u02(spark, sf):
    return listing.stream_names(data.submitted(spark, sf), data.SCOPE)


@query("u03_conflicting_keys", """SELECT 'k' || (c_nationkey) AS key_id, count(DISTINCT c_custkey % 3) AS variants FROM customer
  GROUP BY 1 HAVING count(DISTINCT c_custkey % 3) > 1""")
def u03(spark, sf):
    rows = data.raw(spark, sf, "customer").select(F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("key_id"),
                                                  (F.col("c_custkey") % 3).cast("string").cast("binary").alias("public_key"))
    return conflicting_key_ids(rows)


@query("k11_list_events", _status_sql("""event_id, stream, sequence, action, actor_id AS actor, data, status""",
                                      "stream = 'click' AND recorded_at < '2024-01-28' ORDER BY recorded_at DESC, event_id DESC LIMIT 50"))
def k11(spark, sf):
    rows = view.list_events(data.chain(spark, sf), data.run_tables(spark, sf)[1], data.SCOPE, stream="click", until="2024-01-28")
    return rows.select("event_id", "stream", "sequence", "action", F.col("actor.id").alias("actor"), "data", "status")


@query("k11_list_failed_events", _status_sql("event_id, stream, sequence",
                                             "status = 'failed' ORDER BY recorded_at DESC, event_id DESC LIMIT 20"))
def k11_failed(spark, sf):
    return view.list_events(data.chain(spark, sf), data.run_tables(spark, sf)[1], data.SCOPE, status="failed", limit=20).select(
        "event_id", "stream", "sequence")


@query("k12_overview", "WITH " + HEADS + f""" SELECT 'total' AS part, (SELECT sum(head_sequence) FROM heads) AS value
  UNION ALL SELECT 'today', (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '{_DAY}') UNION ALL SELECT 'days', 14
  UNION ALL SELECT 'counted', (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-29')
  UNION ALL SELECT 'failing', (SELECT count(*) FROM heads) UNION ALL SELECT 'recent', 8""", longs="value")
def k12(spark, sf):
    parts = view.overview(data.chain(spark, sf), data.streams(spark, sf), data.run_tables(spark, sf)[1], data.SCOPE, NOW)
    values = {"total": parts["stats"].agg(F.sum("events_total")), "today": parts["today"].agg(F.sum("events_today")),
              "days": parts["per_day"].agg(F.count(F.lit(1))), "counted": parts["per_day"].agg(F.sum("events")),
              "failing": parts["health"].agg(F.sum("failing")), "recent": parts["recent"].agg(F.count(F.lit(1)))}
    out = None
    for name, df in values.items():
        row = df.toDF("value").select(F.lit(name).alias("part"), F.col("value").cast("long").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


@query("f03_window_bounds", f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate::TIMESTAMP, '{STAMP}')
  WHEN 1 THEN strftime(o_orderdate::TIMESTAMP - INTERVAL 90 MINUTE, '{STAMP}') END AS bound FROM orders""")
def f03_bounds(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T00:00:00+01:30"))) \
        .otherwise(F.concat(day, F.lit(" noon")))
    return data.raw(spark, sf, "orders").select("o_orderkey", window_bound(text).alias("bound"))


