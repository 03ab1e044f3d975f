"""Sealing, ordered operators, verification checks and composite jobs."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.config import ZERO_HASH, VerifyOptions
from tracewright.operators import guards, keys as key_ops, listing
from tracewright.operators.joins import lookup_join
from tracewright.operators.ordered import first_per_key, number_rows, running_max, spread_bucket, with_previous
from tracewright.plans import verify as plan
from tracewright.plans.checkpointing import checkpoint_streams
from tracewright.functions.times import format_time
from tracewright.plans.seal import number_and_clamp, seal
from tracewright.schemas import CONTEXT_KEY, STREAM_KEY
from tracewright.suite import data
from tracewright.suite.registry import ORACLES, query
from tracewright.suite.sql import CHAIN, HEADS, KEY_OF, PRESENT, STAMP, WITH_AV

# A small bucket makes even the small test tables cross bucket borders.
SMALL = 512


# ---- sealing ---------------------------------------------------------------

@query("k02_seal", CHAIN + " SELECT stream, sequence, event_id, recorded_at, key_id, payload_hash, previous_hash, event_hash FROM chain")
def k02(spark, sf):
    return data.chain(spark, sf).select("stream", "sequence", "event_id", "recorded_at", "key_id", "payload_hash",
                                        "previous_hash", "event_hash")


@query("k02_seal_continues_from_heads", CHAIN + f""" SELECT stream, sequence, previous_hash, event_hash FROM chain
  WHERE recorded_at >= '{data.ROTATED}'""")
def k02_heads(spark, sf):
    # The first half is the existing chain; only the second half is sealed here.
    existing = data.chain(spark, sf).where(F.col("recorded_at") < data.ROTATED)
    heads = existing.groupBy(*STREAM_KEY).agg(F.max_by(F.struct("sequence", "event_hash", "recorded_at"), "sequence").alias("h")) \
        .select(*STREAM_KEY, F.col("h.sequence").alias("head_sequence"), F.col("h.event_hash").alias("head_hash"),
                F.col("h.recorded_at").alias("head_recorded_at"))
    rest = data.submitted(spark, sf).where(F.col("recorded_at") >= data.ROTATED)
    return seal(rest, None, heads=heads, bucket_rows=SMALL).select("stream", "sequence", "previous_hash", "event_hash")


@query("k02_seal_many_streams", f"""WITH RECURSIVE hashed AS (SELECT 'c' || conv_id AS stream, turn + 1 AS sequence,
  '{data.TENANT}' AS tenant_id, '{data.PROJECT}' AS project_id,
  'evt_' || lpad(conv_id || 't' || turn, 26, '0') AS event_id, '{data.KEY["a"]}' AS key_id,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INTEGER)), '{STAMP}') AS recorded_at,
  sha256(encode('{data.TAGS.payload}') || '\\x00'::BLOB || encode('{{"action":"message","actor":{{"id":' ||
    CAST(to_json(role) AS VARCHAR) || ',"type":"role"}},"data":' || CAST(to_json(text) AS VARCHAR) || '}}')) AS payload_hash
  FROM conversations), """ + CHAIN[CHAIN.index("links AS"):] + " SELECT stream, sequence, payload_hash, event_hash FROM chain")
def k02_short(spark, sf):
    return data.short_chains(spark, sf).select("stream", "sequence", "payload_hash", "event_hash")


@query("w01_sequence_assignment", WITH_AV + " SELECT event_id, stream, sequence FROM av")
def w01(spark, sf):
    rows = data.submitted(spark, sf)
    return number_rows(rows, STREAM_KEY, [F.col("arrival"), F.col("event_id")],
                       spread_bucket(rows, F.col("arrival"), SMALL)).select("event_id", "stream", "sequence")


@query("w02_recorded_at_clamp", f"""WITH arr AS (SELECT event_type AS stream, event_id,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS sequence,
    strftime(ts - to_hours(CAST(event_id % 7 AS INTEGER)), '{STAMP}') AS proposed FROM events)
  SELECT stream, sequence, max(proposed) OVER (PARTITION BY stream ORDER BY sequence) AS recorded_at FROM arr""")
def w02(spark, sf):
    # Clocks that lag by up to six hours: recorded_at must still never decrease.
    events = data.raw(spark, sf, "events")
    from tracewright.functions.times import format_time
    rows = events.select(F.lit("org").alias("tenant_id"), F.lit("prj").alias("project_id"),
                         F.col("event_type").alias("stream"), F.col("event_id").cast("string").alias("event_id"),
                         F.col("event_id").cast("long").alias("arrival"),
                         format_time(F.col("ts") - F.make_dt_interval(hours=(F.col("event_id") % 7).cast("int"))).alias("recorded_at"))
    return number_and_clamp(rows, bucket_rows=SMALL).select("stream", "sequence", "recorded_at")


@query("w03_previous_hash", CHAIN + f""" SELECT stream, sequence, coalesce(lag(event_hash) OVER
  (PARTITION BY stream ORDER BY sequence), '{ZERO_HASH}') AS previous_stored FROM chain WHERE sequence % 10 <> 4""")
def w03(spark, sf):
    rows = data.chain(spark, sf).where("sequence % 10 <> 4").select(*STREAM_KEY, "sequence", "event_hash")
    out = with_previous(rows, rows, STREAM_KEY, ["sequence"], ["event_hash"], bucket_rows=SMALL)
    return out.select("stream", "sequence", F.coalesce("prev_event_hash", F.lit(ZERO_HASH)).alias("previous_stored"))


@query("w04_previous_sequence", WITH_AV + """ SELECT stream, sequence, coalesce(lag(sequence) OVER
  (PARTITION BY stream ORDER BY sequence), 0) AS previous_sequence FROM av WHERE sequence % 10 <> 4""")
def w04(spark, sf):
    rows = data.chain(spark, sf).where("sequence % 10 <> 4").select(*STREAM_KEY, "sequence")
    out = with_previous(rows, rows, STREAM_KEY, ["sequence"], ["sequence"], bucket_rows=SMALL)
    return out.select("stream", "sequence", F.coalesce("prev_sequence", F.lit(0)).cast("long").alias("previous_sequence"))


@query("w05_last_known_time", WITH_AV + """, t AS (SELECT stream, sequence,
    CASE WHEN sequence % 10 NOT IN (3, 4, 5) THEN recorded_at END AS known FROM av)
  SELECT stream, sequence, last_value(known IGNORE NULLS) OVER (PARTITION BY stream ORDER BY sequence
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_known FROM t""")
def w05(spark, sf):
    rows = data.chain(spark, sf).select(*STREAM_KEY, "sequence", F.when(
        ~(F.col("sequence") % 10).isin(3, 4, 5), F.col("recorded_at")).alias("known"))
    out = with_previous(rows, rows, STREAM_KEY, ["sequence"], ["sequence"], "known", bucket_rows=SMALL)
    return out.select("stream", "sequence", F.col("prev_known").alias("last_known"))


@query("w02_running_maximum", f"""SELECT event_type AS stream, event_id, max(strftime(ts, '{STAMP}')) OVER
  (PARTITION BY event_type ORDER BY event_id) AS newest FROM events""")
def running(spark, sf):
    from tracewright.functions.times import format_time
    rows = data.raw(spark, sf, "events").select(F.col("event_type").alias("stream"), "event_id",
                                                format_time(F.col("ts")).alias("at"))
    return running_max(rows, ["stream"], "event_id", "at", "newest", bucket_rows=SMALL).select("stream", "event_id", "newest")


@query("a08_stream_registry", CHAIN + """ SELECT stream, max(sequence) AS head_sequence, max_by(event_hash, sequence)
  AS head_hash, max_by(recorded_at, sequence) AS head_recorded_at,
  coalesce(max(sequence) FILTER (WHERE sequence % 50 = 0), 0) AS last_checkpoint_sequence FROM chain GROUP BY stream""")
def a08(spark, sf):
    return data.streams(spark, sf).drop("tenant_id", "project_id")


# ---- checks ----------------------------------------------------------------

def _found(code: str, where: str, source: str = "present", extra: str = "") -> str:
    return "WITH " + PRESENT + f""" SELECT stream, sequence, event_id, '{code}' AS code,
      '{"warning" if extra == "w" else "error"}' AS severity FROM {source} WHERE {where}"""


def _check(name: str, code: str, sql: str, severity: str | None = None):
    @query(name, sql)
    def run(spark, sf):
        rows = data.findings(spark, sf).where(F.col("code") == code)
        return rows.select(F.col("ctx_stream").alias("stream"), "sequence", "event_id", "code", "severity")
    return run


_LATE = "r NOT IN (13, 23, 41, 47)"
_check("c01_unsupported_schema_version", "unsupported_schema_version", _found("unsupported_schema_version", "r = 41"))
_check("c02_malformed_record", "malformed_record", _found("malformed_record", "r = 47"))
_check("c03_context_mismatch", "context_mismatch", _found("context_mismatch", "r = 59"))
_check("c04_payload_missing", "payload_missing", _found("payload_missing", "r = 29"))
_check("c05_payload_invalid", "payload_invalid", _found("payload_invalid", "r = 31"))
_check("c06_payload_not_canonical", "payload_not_canonical", _found("payload_not_canonical", "r = 11"))
_check("c07_payload_hash_mismatch", "payload_hash_mismatch", _found("payload_hash_mismatch", "r = 3"))
_check("c08_indexed_field_mismatch", "indexed_field_mismatch", _found("indexed_field_mismatch", "r = 7"))
_check("c09_event_hash_mismatch", "event_hash_mismatch", _found("event_hash_mismatch", "r IN (13, 17, 23, 47, 59) OR swapped"))
_check("c10_unknown_signing_key", "unknown_signing_key", _found("unknown_signing_key", "r = 23"))
_check("c11_signature_invalid", "signature_invalid", _found("signature_invalid", "r = 19"))
_check("c12_signing_key_invalid", "signing_key_invalid", "WITH " + PRESENT + """ SELECT stream, CAST(0 AS BIGINT) AS sequence,
  CAST(NULL AS VARCHAR) AS event_id, 'signing_key_invalid' AS code, 'error' AS severity FROM heads""")
_check("c13_signing_key_revoked", "signing_key_revoked", _found(
    "signing_key_revoked", f"key_id = '{data.KEY['b']}' AND recorded_at > '2024-01-25T00:05:00.000000Z' AND {_LATE}"))
_check("c14_signing_key_outside_validity", "signing_key_outside_validity", _found(
    "signing_key_outside_validity", f"(r = 13) OR (key_id = '{data.KEY['a']}' AND recorded_at > '2024-01-10T00:05:00.000000Z' AND {_LATE})", extra="w"))
_check("c15_sequence_gap", "sequence_gap", _found("sequence_gap", "r = 38"))
_check("c16_sequence_out_of_order", "sequence_out_of_order", _found("sequence_out_of_order", "copy = 2"))
_check("c17_previous_hash_mismatch", "previous_hash_mismatch", _found(
    "previous_hash_mismatch", "r IN (17, 38) OR copy = 2 OR swapped OR (r = 45)"))
_check("c19_timestamp_regression", "timestamp_regression", _found("timestamp_regression", "r = 13 OR (swapped AND old % 100 = 43)"))
_check("c20_head_mismatch", "head_mismatch", "WITH " + PRESENT + """ SELECT stream, tail + 1 AS sequence,
  CAST(NULL AS VARCHAR) AS event_id, 'head_mismatch' AS code, 'error' AS severity FROM tails""")

_CPS = PRESENT + """, cps AS (SELECT a.stream, a.sequence, t.tail, a.event_id FROM av a JOIN tails t USING (stream)
  WHERE a.sequence % 50 = 0 OR a.sequence = t.n)"""
_check("c21_checkpoint_invalid", "checkpoint_invalid", "WITH " + _CPS + """ SELECT stream, sequence,
  CAST(NULL AS VARCHAR) AS event_id, 'checkpoint_invalid' AS code, 'error' AS severity FROM cps WHERE sequence % 400 = 100""")
_check("c22_checkpoint_mismatch", "checkpoint_mismatch", "WITH " + _CPS + """ SELECT stream, sequence, event_id,
  'checkpoint_mismatch' AS code, 'error' AS severity FROM cps WHERE sequence % 400 = 200 AND sequence <= tail""")
_check("c23_checkpoint_beyond_head", "checkpoint_beyond_head", "WITH " + _CPS + """ SELECT stream, sequence,
  CAST(NULL AS VARCHAR) AS event_id, 'checkpoint_beyond_head' AS code, 'error' AS severity FROM cps
  WHERE sequence % 400 <> 100 AND sequence > tail""")


@query("c15_gap_values", "WITH " + PRESENT + """ SELECT stream, sequence, CAST(sequence - 1 AS VARCHAR) AS expected,
  CAST(sequence AS VARCHAR) AS found, 'after sequence ' || (sequence - 2) || ' comes ' || sequence ||
  '; absent in between: 1' AS message FROM present WHERE r = 38""")
def c15_values(spark, sf):
    return data.findings(spark, sf).where("code = 'sequence_gap'").select(
        F.col("ctx_stream").alias("stream"), "sequence", "expected", "found", "message")


@query("c18_anchor_mismatch", WITH_AV + """ SELECT stream, 41 AS sequence, 'anchor_mismatch' AS code
  FROM av GROUP BY stream HAVING max(sequence) > 40""", longs="sequence")
def c18(spark, sf):
    # Segments from record 41 on, anchored at a position whose hash is wrong.
    events = data.chain(spark, sf).where("sequence > 40")
    anchors = data.chain(spark, sf).where("sequence = 40").select(
        *[F.col(k).alias(c) for k, c in zip(STREAM_KEY, CONTEXT_KEY)], F.lit(40).cast("long").alias("anchor_sequence"),
        F.reverse("event_hash").alias("anchor_hash"), F.lit("checkpoint").alias("anchor_description"))
    found = plan.verify_segment(events, data.keys(spark), anchors).findings()
    return found.select(F.col("ctx_stream").alias("stream"), "sequence", "code")


@query("k04_verify_segment", WITH_AV + """ SELECT stream, count(*) - 50 AS events_checked, 51 AS first_sequence,
  max(sequence) AS last_sequence, 0 AS failure_count, true AS valid FROM av GROUP BY stream HAVING max(sequence) > 50""", longs="first_sequence failure_count")
def k04(spark, sf):
    # Anchored at the checkpoint of record 50; the checkpoint describes the anchor itself.
    cps = data.checkpoints(spark, sf)
    anchors = cps.where("sequence = 50").select(
        *[F.col(k).alias(c) for k, c in zip(STREAM_KEY, CONTEXT_KEY)], F.col("sequence").alias("anchor_sequence"),
        F.col("head_hash").alias("anchor_hash"), F.concat(F.lit("checkpoint "), F.col("checkpoint_id")).alias("anchor_description"))
    return plan.verify_segment(data.chain(spark, sf).where("sequence > 50"), data.keys(spark), anchors, checkpoints=cps,
                               streams=data.streams(spark, sf)).reports().select(
        F.col("ctx_stream").alias("stream"), "events_checked", "first_sequence", "last_sequence", "failure_count", "valid")


#: Findings that belong to one record.
_OF_RECORDS = f"""
  SELECT stream, sequence, 1 AS n FROM present WHERE r IN (3, 7, 11, 19, 23, 29, 31, 41, 47, 59)
  UNION ALL SELECT stream, sequence, 1 FROM present WHERE r IN (13, 17, 23, 47, 59) OR swapped
  UNION ALL SELECT stream, sequence, 1 FROM present WHERE key_id = '{data.KEY["b"]}' AND {_LATE}
    AND recorded_at > '2024-01-25T00:05:00.000000Z'
  UNION ALL SELECT stream, sequence, 1 FROM present WHERE r = 38 OR copy = 2
  UNION ALL SELECT stream, sequence, 1 FROM present WHERE r IN (17, 38) OR copy = 2 OR swapped OR r = 45
  UNION ALL SELECT stream, sequence, 1 FROM present WHERE r = 13 OR (swapped AND old % 100 = 43)"""
_COUNTS = PRESENT + f""", found AS ({_OF_RECORDS}
  UNION ALL SELECT stream, tail + 1, 1 FROM tails
  UNION ALL SELECT stream, 0, 1 FROM heads
  UNION ALL SELECT c.stream, c.sequence, 1 FROM (SELECT a.stream, a.sequence, t.tail FROM av a JOIN tails t USING (stream)
    WHERE a.sequence % 50 = 0 OR a.sequence = t.n) c WHERE c.sequence % 400 IN (100, 200) OR c.sequence > c.tail)"""


@query("k03_verify_streams", "WITH " + _COUNTS + """ SELECT p.stream, p.events_checked, p.payloads_checked,
    p.first_sequence, p.last_sequence, f.failure_count, false AS valid, 3 AS first_failure_sequence,
    'payload_hash_mismatch' AS first_failure_code
  FROM (SELECT stream, count(*) AS events_checked, count(*) FILTER (WHERE r <> 29) AS payloads_checked,
          min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM present GROUP BY stream) p
  JOIN (SELECT stream, count(*) AS failure_count FROM found GROUP BY stream) f USING (stream)""", longs="first_failure_sequence")
def k03(spark, sf):
    return data.tampered_verification(spark, sf).reports().select(
        F.col("ctx_stream").alias("stream"), "events_checked", "payloads_checked", "first_sequence", "last_sequence",
        "failure_count", "valid", F.col("first_failure.sequence").alias("first_failure_sequence"),
        F.col("first_failure.code").alias("first_failure_code"))


@query("k03_verify_clean_streams", WITH_AV + """ SELECT stream, count(*) AS events_checked, 0 AS failure_count,
  0 AS warning_count, count(*) FILTER (WHERE sequence % 50 = 0) AS checkpoints_verified, 'valid' AS hash_chain,
  'valid' AS payload_hashes, 'valid' AS signatures, 'valid' AS ordering,
  CASE WHEN count(*) >= 50 THEN 'valid' ELSE 'skipped' END AS checkpoints,
  'valid' AS stream_head, 'skipped' AS package, 'valid' AS result FROM av GROUP BY stream""", longs="failure_count warning_count")
def k03_clean(spark, sf):
    return data.clean_verification(spark, sf).reports().select(
        F.col("ctx_stream").alias("stream"), "events_checked", "failure_count", "warning_count", "checkpoints_verified",
        "hash_chain", "payload_hashes", "signatures", "ordering", "checkpoints", "stream_head", "package", "result")


@query("k03_verify_many_streams", """SELECT count(DISTINCT conv_id) AS streams, count(*) AS events_checked,
  0 AS failures, count(DISTINCT conv_id) AS valid FROM conversations""", longs="failures")
def k03_short(spark, sf):
    chain = data.short_chains(spark, sf)
    out = plan.verify_streams(chain, data.keys(spark)).reports()
    return out.agg(F.count(F.lit(1)).alias("streams"), F.sum("events_checked").alias("events_checked"),
                   F.sum("failure_count").alias("failures"), F.count_if("valid").alias("valid"))


@query("a10_report_rollup", CHAIN + """ SELECT stream, count(*) AS events_checked, count(*) AS payloads_checked,
  min(sequence) AS first_sequence, max(sequence) AS last_sequence, max_by(event_hash, sequence) AS last_event_hash
  FROM chain GROUP BY stream""")
def a10(spark, sf):
    return data.clean_verification(spark, sf).reports().select(
        F.col("ctx_stream").alias("stream"), "events_checked", "payloads_checked", "first_sequence", "last_sequence",
        "last_event_hash")


@query("a11_keys_used", WITH_AV + f""", k AS (SELECT stream, key_id FROM av UNION SELECT stream, '{data.KEY["b"]}' FROM av WHERE sequence >= 50)
  SELECT stream, string_agg(key_id, ',' ORDER BY key_id) AS keys_used FROM k GROUP BY stream""")
def a11(spark, sf):
    return data.clean_verification(spark, sf).reports().select(
        F.col("ctx_stream").alias("stream"), F.array_join("keys_used", ",").alias("keys_used"))


@query("a12_checkpoints_verified", "WITH " + _CPS + """ SELECT stream, count(*) FILTER (WHERE sequence % 400 <> 100
  AND sequence <= tail) AS checkpoints_verified FROM cps GROUP BY stream""")
def a12(spark, sf):
    return data.tampered_verification(spark, sf).reports().select(F.col("ctx_stream").alias("stream"), "checkpoints_verified")


@query("a13_check_status", "WITH " + _CPS + """ SELECT stream, 'invalid' AS hash_chain, 'invalid' AS payload_hashes,
  'invalid' AS signatures, 'invalid' AS ordering, 'invalid' AS checkpoints, 'invalid' AS stream_head, 'skipped' AS package
  FROM cps GROUP BY stream""")
def a13(spark, sf):
    return data.tampered_verification(spark, sf).reports().select(
        F.col("ctx_stream").alias("stream"), "hash_chain", "payload_hashes", "signatures", "ordering", "checkpoints",
        "stream_head", "package")


@query("a14_first_failure", "WITH " + _COUNTS + """, m AS (SELECT stream, min(sequence) FILTER (WHERE sequence > 0) AS sequence
  FROM found GROUP BY stream) SELECT stream, sequence FROM m""")
def a14(spark, sf):
    return data.tampered_verification(spark, sf).reports().select(
        F.col("ctx_stream").alias("stream"), F.col("first_failure.sequence").alias("sequence"))


@query("a15_failure_sequences", "WITH " + PRESENT + """, s AS (SELECT DISTINCT stream, sequence FROM present
  WHERE r IN (3, 7, 11, 13, 17, 19, 23, 29, 31, 38, 41, 45, 47, 59) OR copy = 2 OR swapped)
  SELECT stream, sequence FROM s""")
def a15(spark, sf):
    # Findings of the records alone: no key, head or checkpoint findings share the list.
    out = plan.verify_streams(data.tampered(spark, sf), data.keys(spark), options=VerifyOptions(max_failures=1_000_000))
    listed = plan.failure_sequences(out)
    return listed.select(F.col("ctx_stream").alias("stream"), F.explode("failure_sequences").alias("sequence"))


@query("a15_listed_sequences", "WITH " + PRESENT + """, s AS (SELECT DISTINCT stream, sequence FROM present
  WHERE r IN (3, 7, 11, 13, 17, 19, 23, 29, 31, 38, 41, 45, 47, 59) OR copy = 2 OR swapped)
  SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY sequence) AS position, sequence FROM s""")
def a15_listed(spark, sf):
    out = plan.verify_streams(data.tampered(spark, sf), data.keys(spark), options=VerifyOptions(max_failures=1_000_000))
    return plan.listed_sequences(out).select(F.col("ctx_stream").alias("stream"), "position", "sequence")


@query("a16_project_rollup", "WITH " + _COUNTS + f""" SELECT '{data.PROJECT}' AS project_id, (SELECT count(*) FROM heads) AS streams_checked,
  (SELECT count(*) FROM present) AS events_checked, (SELECT count(*) FROM found) AS failure_count, false AS valid, 'invalid' AS result""")
def a16(spark, sf):
    return plan.project_reports(data.tampered_verification(spark, sf).reports()).select(
        F.col("ctx_project_id").alias("project_id"), "streams_checked", "events_checked", "failure_count", "valid", "result")


@query("k06_verify_projects", f"""SELECT 'prj_' || lpad(CAST(user_id % 7 AS VARCHAR), 10, '0') AS project_id, count(DISTINCT event_type) AS streams_checked,
  count(*) AS events_checked, 0 AS failure_count, 'valid' AS result FROM events GROUP BY 1""", longs="failure_count")
def k06(spark, sf):
    # Seven projects, every stream of every project in one job; keys belong to a project, so each has its own rows.
    rows = data.submitted(spark, sf).withColumn("project_id", F.concat(F.lit("prj_"), F.lpad(
        (F.substring("actor_id", 6, 20).cast("long") % 7).cast("string"), 10, "0")))
    sealed = data.once(spark, sf, "projects", lambda: seal(rows, data.SEEDS))
    projects = F.array(*(F.lit(f"prj_{i:010d}") for i in range(7)))
    keys = data.keys(spark).withColumn("project_id", F.explode(projects))
    out = plan.verify_streams(sealed, keys, pinned=True)
    return plan.project_reports(out.reports()).select(
        F.col("ctx_project_id").alias("project_id"), "streams_checked", "events_checked", "failure_count", "result")


@query("a18_findings_by_code", "WITH " + PRESENT + """, c AS (SELECT
    count(*) FILTER (WHERE r = 3) AS a, count(*) FILTER (WHERE r = 29) AS b, count(*) FILTER (WHERE r = 19) AS d,
    count(*) FILTER (WHERE r = 38) AS e FROM present)
  SELECT * FROM (SELECT 'payload_hash_mismatch' AS code, 'payloadHashes' AS "check", a AS findings FROM c
  UNION ALL SELECT 'payload_missing', 'payloadHashes', b FROM c UNION ALL SELECT 'signature_invalid', 'signatures', d FROM c
  UNION ALL SELECT 'sequence_gap', 'ordering', e FROM c) WHERE findings > 0""")
def a18(spark, sf):
    return plan.findings_by_code(data.findings(spark, sf)).where(
        F.col("code").isin("payload_hash_mismatch", "payload_missing", "signature_invalid", "sequence_gap"))


_OWN_CODES = [sql for name, sql in ORACLES.items() if name[:3] in {f"c{i:02d}" for i in range(1, 24)} - {"c18"} and name != "c15_gap_values"]


@query("a18_all_findings_by_code", """WITH named(code, "check") AS (VALUES ('unsupported_schema_version', 'hashChain'), ('malformed_record', 'hashChain'),
    ('context_mismatch', 'hashChain'), ('event_hash_mismatch', 'hashChain'), ('previous_hash_mismatch', 'hashChain'),
    ('payload_missing', 'payloadHashes'), ('payload_invalid', 'payloadHashes'), ('payload_not_canonical', 'payloadHashes'),
    ('payload_hash_mismatch', 'payloadHashes'), ('indexed_field_mismatch', 'payloadHashes'),
    ('unknown_signing_key', 'signatures'), ('signature_invalid', 'signatures'), ('signing_key_invalid', 'signatures'),
    ('signing_key_revoked', 'signatures'), ('signing_key_outside_validity', 'signatures'),
    ('sequence_gap', 'ordering'), ('sequence_out_of_order', 'ordering'), ('timestamp_regression', 'ordering'), ('head_mismatch', 'streamHead'),
    ('checkpoint_invalid', 'checkpoints'), ('checkpoint_mismatch', 'checkpoints'), ('checkpoint_beyond_head', 'checkpoints'))
  SELECT code, "check", count(*) AS findings FROM (""" + " UNION ALL ".join(f"(SELECT code FROM ({sql}))" for sql in _OWN_CODES) + """)
  LEFT JOIN named USING (code) GROUP BY ALL""")
def a18_all(spark, sf):
    # Every code of every category over the whole tampered chain, warnings included.
    return plan.findings_by_code(data.findings(spark, sf))


@query("w06_failure_cap", "WITH " + _COUNTS + """, t AS (SELECT stream, count(*) AS n FROM found GROUP BY stream),
  w AS (SELECT stream, count(*) AS n FROM present WHERE r = 13 OR (key_id = '""" + data.KEY["a"] + "' AND " + _LATE + """
    AND recorded_at > '2024-01-10T00:05:00.000000Z') GROUP BY stream)
  SELECT stream, 'error' AS severity, least(n, 10) AS listed, n > 10 AS truncated FROM t
  UNION ALL SELECT stream, 'warning', least(n, 10), n > 10 FROM w""")
def w06(spark, sf):
    found = data.findings(spark, sf)
    from tracewright.operators.ordered import top_per_key
    listed = top_per_key(found, ["ctx_stream", "severity"], [F.col("emission")], 10)
    totals = found.groupBy("ctx_stream", "severity").agg(F.count(F.lit(1)).alias("n"))
    return listed.groupBy("ctx_stream", "severity").agg(F.count(F.lit(1)).alias("listed")) \
        .join(totals, ["ctx_stream", "severity"]).select(F.col("ctx_stream").alias("stream"), "severity", "listed",
                                                         (F.col("n") > 10).alias("truncated"))


@query("w06_listed_findings", "WITH " + PRESENT + ", of_records AS (" + _OF_RECORDS + """), listed AS (
  SELECT stream, sequence, row_number() OVER (PARTITION BY stream ORDER BY sequence) AS position FROM of_records)
  SELECT stream, position, sequence FROM listed WHERE position <= 25""")
def w06_listed(spark, sf):
    # Which errors of records a report of 25 lists; findings of one record share its number.
    own = data.findings(spark, sf).where("severity = 'error' AND sequence > 0 AND check NOT IN ('checkpoints', 'streamHead')")
    return first_per_key(own, ["ctx_stream"], [F.col("emission")], plan.emission_bucket(50), 25) \
        .select(F.col("ctx_stream").alias("stream"), "position", "sequence")


@query("u01_findings_union", "WITH " + _COUNTS + " SELECT stream, sequence, count(*) AS findings FROM found GROUP BY ALL")
def u01(spark, sf):
    return data.findings(spark, sf).where("severity = 'error'").groupBy(F.col("ctx_stream").alias("stream"), "sequence") \
        .agg(F.count(F.lit(1)).alias("findings"))


@query("j08_neighbours", WITH_AV + """ SELECT a.stream, a.sequence, p.event_id AS before_id, n.event_id AS after_id FROM av a
  LEFT JOIN av p ON p.stream = a.stream AND p.sequence = a.sequence - 1 AND p.sequence % 10 <> 4
  LEFT JOIN av n ON n.stream = a.stream AND n.sequence = a.sequence + 1 AND n.sequence % 10 <> 4 WHERE a.sequence % 10 <> 4""")
def j08(spark, sf):
    return listing.neighbours(data.chain(spark, sf).where("sequence % 10 <> 4")).select("stream", "sequence", "before_id", "after_id")


@query("j09_link_explanation", "WITH " + PRESENT + """ SELECT stream, sequence,
  CASE WHEN copy = 2 THEN sequence - 1 ELSE sequence - 2 END AS named FROM present
  WHERE copy = 2 OR (swapped AND sequence % 100 = 44) OR (r = 45 AND sequence > 1)""")
def j09(spark, sf):
    # A duplicate names the record before its original (one before the preceding
    # row); swapped records name one another.
    found = data.findings(spark, sf).where("code = 'previous_hash_mismatch' AND message LIKE 'the previous hash is that of%'")
    return found.select(F.col("ctx_stream").alias("stream"), "sequence",
                        F.regexp_extract("message", r"that of sequence ([0-9]+), not", 1).cast("long").alias("named"))


@query("j12_head_against_tail", "WITH " + PRESENT + """ SELECT stream, CASE WHEN stream = 'click' THEN 'skipped' ELSE 'invalid' END AS stream_head,
  CASE WHEN stream = 'click' THEN 0 ELSE tail + 1 END AS missing_from FROM tails""")
def j12(spark, sf):
    # The last records are gone everywhere; one stream has lost its registry row too, so there is nothing to compare it with.
    out = plan.verify_streams(data.tampered(spark, sf), data.keys(spark), streams=data.streams(spark, sf).where("stream <> 'click'"))
    found = out.findings().where("code = 'head_mismatch'").select("ctx_stream", F.col("sequence").alias("missing_from"))
    return out.reports().join(found, "ctx_stream", "left").select(F.col("ctx_stream").alias("stream"), "stream_head", F.coalesce("missing_from", F.lit(0)).alias("missing_from"))


@query("k05_verify_events", "WITH " + PRESENT + """ SELECT event_id AS target_id,
  CASE r WHEN 60 THEN 2 ELSE 1 END AS failure_count FROM present WHERE r IN (3, 19, 38, 60) AND sequence < last""", longs="failure_count")
def k05(spark, sf):
    # Records 3 and 19 fail on their own, 38 lacks its predecessor, 60 has a
    # predecessor stored under another tenant (its header and its hash differ).
    chain = data.tampered(spark, sf)
    ends = data.streams(spark, sf).select(F.col("stream").alias("ctx_stream"), (F.col("head_sequence") - 3).alias("last"))
    targets = lookup_join(chain, ends, ["ctx_stream"], "inner").where(
        (F.col("sequence") % 100).isin(3, 19, 38, 60) & (F.col("sequence") < F.col("last")))
    out = plan.verify_events(targets, chain, data.keys(spark), streams=data.streams(spark, sf))
    return out.reports().select("target_id", "failure_count")


# ---- guards ----------------------------------------------------------------

@query("g01_link_guard", "WITH " + PRESENT + """ SELECT stream, sequence, violation FROM (SELECT p.stream, p.sequence,
  CASE WHEN r = 38 THEN 'predecessor_missing' WHEN r = 17 OR swapped OR r = 45 THEN 'hash_mismatch'
  WHEN r = 13 OR (r = 47 AND p.recorded_at < b.recorded_at) THEN 'time_decreases' END AS violation
  FROM present p LEFT JOIN av b ON b.stream = p.stream AND b.sequence = p.sequence - 1 WHERE copy = 1)
  WHERE violation IS NOT NULL""")
def g01(spark, sf):
    rows = data.tampered(spark, sf).withColumn("tenant_id", F.col("ctx_tenant_id")).dropDuplicates([*STREAM_KEY, "sequence"])
    return guards.link_guard(rows.select(*STREAM_KEY, "sequence", "event_id", "previous_hash", "event_hash", "recorded_at")) \
        .select("stream", "sequence", "violation")


@query("g02_head_guard", "WITH " + HEADS + """ SELECT stream, CASE WHEN stream = 'click' THEN 'head_moves_backwards'
  WHEN stream = 'error' THEN 'head_without_event' WHEN stream = 'view' THEN 'checkpoint_moves_backwards'
  ELSE 'identity_changed' END AS violation FROM heads WHERE stream IN ('click', 'error', 'view', 'signup')""")
def g02(spark, sf):
    new = data.streams(spark, sf)
    is_ = lambda name: F.col("stream") == name
    changed = new.where("stream <> 'signup'") \
        .withColumn("head_sequence", F.when(is_("click"), F.col("head_sequence") - 1).otherwise(F.col("head_sequence"))) \
        .withColumn("head_hash", F.when(is_("error"), F.reverse("head_hash")).otherwise(F.col("head_hash"))) \
        .withColumn("last_checkpoint_sequence", F.when(is_("view"), F.lit(0).cast("long"))
                    .otherwise(F.col("last_checkpoint_sequence")))
    return guards.head_guard(new, changed, data.chain(spark, sf)).select("stream", "violation")


@query("g03_checkpoint_guard", WITH_AV + " SELECT stream, sequence FROM av WHERE sequence % 400 = 200")
def g03(spark, sf):
    return guards.checkpoint_guard(data.tampered_checkpoints(spark, sf), data.chain(spark, sf)).select("stream", "sequence")


@query("j13_dangling_heads", "WITH " + HEADS + " SELECT stream, head_sequence FROM heads")
def j13(spark, sf):
    # All heads dangle once the last records are gone.
    rows = data.tampered(spark, sf)
    return guards.dangling_heads(data.streams(spark, sf), rows).select("stream", F.col("sequence").alias("head_sequence"))


@query("g04_key_guard", "SELECT c_custkey, 'retired_key_reactivated' AS violation FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0 "
       "UNION ALL SELECT c_custkey, 'material_changed' FROM customer WHERE c_custkey % 5 = 0")
def g04(spark, sf):
    # Two keys of a third of the customers, one of the others; some old ones come back, some new ones change.
    old, n = data.customer_keys(spark, sf), F.substring("project_id", 5, 10).cast("long")
    new = old.withColumn("fingerprint", F.when((F.col("status") == "active") & (n % 5 == 0), F.lit("0" * 64)).otherwise(F.col("fingerprint"))) \
        .withColumn("status", F.when((F.col("status") == "retired") & (n % 2 == 0), F.lit("active")).otherwise(F.col("status")))
    return guards.key_guard(old, new).select(n.cast("long").alias("c_custkey"), "violation")


@query("g05_append_only_guard", "WITH " + PRESENT + """ SELECT stream, sequence, event_id FROM av a WHERE a.sequence > (SELECT h.head_sequence - 3
  FROM heads h WHERE h.stream = a.stream) OR a.sequence % 100 IN (3, 37)""")
def g05(spark, sf):
    old = data.chain(spark, sf).select("stream", "sequence", "event_id", "content")
    ends = data.streams(spark, sf).select("stream", (F.col("head_sequence") - 3).alias("last"))
    new = lookup_join(old, ends, ["stream"], "inner").where("sequence <= last AND sequence % 100 <> 37").withColumn(
        "content", F.when(F.col("sequence") % 100 == 3, F.lit("{}")).otherwise(F.col("content")))
    return guards.append_only_guard(old, new.drop("last")).select("stream", "sequence", "event_id")


@query("g06_column_checks", "WITH " + PRESENT + """ SELECT stream, sequence, violation FROM (
  SELECT stream, sequence, unnest(CASE r WHEN 29 THEN ['content'] WHEN 41 THEN ['schema_version'] WHEN 47 THEN ['recorded_at']
    WHEN 19 THEN ['signature'] ELSE [] END) AS violation FROM present)""")
def g06(spark, sf):
    return guards.event_checks(data.tampered(spark, sf)).select("stream", "sequence", "violation")


@query("g06_uniqueness", "WITH " + PRESENT + """, twice AS (SELECT tenant_id || '/' || project_id || '/' || stream || '/' || sequence AS place, event_id FROM present WHERE copy = 2)
  SELECT 'id' AS rule, event_id AS value, 2 AS copies FROM twice UNION ALL SELECT 'stream_sequence', place, 2 FROM twice""", longs="copies")
def g06_unique(spark, sf):
    return guards.event_uniqueness(data.tampered(spark, sf)).where("rule <> 'event_hash'")


@query("g06_unique_hashes", "WITH " + PRESENT + " SELECT event_id AS value, 2 AS copies FROM present WHERE copy = 2", longs="copies")
def g06_hashes(spark, sf):
    # The hashes themselves are long to compute in SQL; each is named by its record.
    rows = data.tampered(spark, sf)
    found = guards.event_uniqueness(rows).where("rule = 'event_hash'")
    names = rows.select(F.col("event_hash").alias("value"), "event_id").distinct()
    return found.join(names, "value").select(F.col("event_id").alias("value"), "copies")


@query("g06_one_active_key", """SELECT lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS project, count(*) AS copies FROM customer
  WHERE c_custkey % 2 = 0 GROUP BY 1 HAVING count(*) > 1""")
def g06_active(spark, sf):
    keys = data.raw(spark, sf, "customer").select(
        F.lit(data.TENANT).alias("tenant_id"), F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("project_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("active")).otherwise(F.lit("retired")).alias("status"))
    return guards.active_key_guard(keys).select(F.substring_index("value", "/", -1).alias("project"), "copies")


# ---- keys and checkpoints ---------------------------------------------------

@query("w08_rotation_timeline", """SELECT c_custkey, 'old' AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'contiguous' ELSE 'gap' END AS transition
  FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'key', 'last' FROM customer""")
def w08(spark, sf):
    timeline = key_ops.rotation_timeline(data.customer_keys(spark, sf))
    return timeline.select(F.substring("project_id", 5, 10).cast("long").alias("c_custkey"),
                           F.when(F.col("status") == "retired", F.lit("old")).otherwise(F.lit("key")).alias("kind"), "transition")


@query("j15_events_per_key", WITH_AV + f""" SELECT k.key_id, count(a.key_id) AS event_count FROM
  (VALUES ('{data.KEY["a"]}'), ('{data.KEY["b"]}'), ('{data.KEY["c"]}')) k(key_id) LEFT JOIN av a USING (key_id) GROUP BY k.key_id""")
def j15(spark, sf):
    return key_ops.events_per_key(data.chain(spark, sf), data.keys(spark, "judged")).select("key_id", "event_count")


@query("a06_newest_event_per_key", WITH_AV + " SELECT key_id, max(recorded_at) AS newest_recorded_at FROM av GROUP BY key_id")
def a06(spark, sf):
    return key_ops.newest_event_per_key(data.chain(spark, sf)).select("key_id", "newest_recorded_at")


_NEWEST = f"""SELECT c_custkey, max(strftime(o_orderdate::TIMESTAMP, '{STAMP}')) AS newest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""


@query("k13_close_key_window", f"""WITH n AS ({_NEWEST}), e AS (SELECT c_custkey, greatest('{data.ROTATION}', coalesce(newest, '{data.ROTATION}')) AS closes FROM n)
  SELECT c_custkey, {KEY_OF.format("'key' || c_custkey")} AS key_id, CASE WHEN c_custkey % 2 = 0 THEN 'retired' ELSE 'active' END AS status,
         CASE WHEN c_custkey % 2 = 0 THEN closes END AS retired_at FROM e
  UNION ALL SELECT c_custkey, {KEY_OF.format("'old' || c_custkey")}, 'retired', CASE WHEN c_custkey % 2 = 0 THEN '{data.KEYED}' ELSE '{data.KEYED_EARLY}' END FROM e WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, {KEY_OF.format("'new' || c_custkey")}, 'active', NULL FROM e WHERE c_custkey % 2 = 0""")
def k13(spark, sf):
    # Every second customer rotates, each to a key of its own.
    keys = data.customer_keys(spark, sf)
    active = keys.where("status = 'active'").select("tenant_id", "project_id", "key_id")
    orders = data.raw(spark, sf, "orders").select(
        F.concat(F.lit("prj_"), F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("project_id"), format_time(F.col("o_orderdate").cast("timestamp_ntz")).alias("recorded_at"))
    events = orders.join(active, "project_id")
    asked = data.rotations(spark, sf).where(F.substring("project_id", 5, 10).cast("long") % 2 == 0)
    return key_ops.close_key_window(keys, events, asked).select(
        F.substring("project_id", 5, 10).cast("long").alias("c_custkey"), "key_id", "status", "retired_at")


@query("k14_revoke_key", f"""SELECT c_custkey, {KEY_OF.format("'key' || c_custkey")} AS key_id, CASE WHEN c_custkey % 2 = 0 THEN 'revoked' ELSE 'active' END AS status,
         CASE WHEN c_custkey % 2 = 0 THEN '{data.ROTATION}' END AS retired_at, CASE WHEN c_custkey % 2 = 0 THEN '{data.ROTATION}' END AS revoked_at FROM customer
  UNION ALL SELECT c_custkey, {KEY_OF.format("'old' || c_custkey")}, 'retired', CASE WHEN c_custkey % 2 = 0 THEN '{data.KEYED}' ELSE '{data.KEYED_EARLY}' END, NULL FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, {KEY_OF.format("'new' || c_custkey")}, 'active', NULL, NULL FROM customer WHERE c_custkey % 2 = 0""")
def k14(spark, sf):
    keys = data.customer_keys(spark, sf)
    active = keys.where("status = 'active'").select("tenant_id", "project_id", "key_id")
    asked = data.rotations(spark, sf).where(F.substring("project_id", 5, 10).cast("long") % 2 == 0).join(active, ["tenant_id", "project_id"])
    return key_ops.revoke_key(keys, asked).select(
        F.substring("project_id", 5, 10).cast("long").alias("c_custkey"), "key_id", "status", "retired_at", "revoked_at")


@query("k07_checkpoint_streams", CHAIN + f""" SELECT stream, max(sequence) AS sequence, max_by(event_hash, sequence) AS head_hash,
  '{data.NOW}' AS created_at FROM chain GROUP BY stream HAVING max(sequence) % 50 > 0""")
def k07(spark, sf):
    return checkpoint_streams(data.streams(spark, sf), data.checkpoints(spark, sf), data.SEEDS, data.KEY["b"], data.NOW,
                              min_events=1, max_age_seconds=3600).select("stream", "sequence", "head_hash", "created_at")


@query("k15_throughput", """SELECT 'orders' AS stream, count(*) AS events_checked, 0 AS failures_before, 1 AS failures_after,
  'payload_hash_mismatch' AS first_code, 501 AS first_sequence FROM orders""", longs="failures_before failures_after first_sequence")
def k15(spark, sf):
    # The whole path on requests with before and after states, all in one stream.
    from tracewright.plans.throughput import throughput
    requests = data.requests(spark, sf).withColumn("arrival", F.col("o_orderkey"))
    return throughput(requests, data.keys(spark), data.SEEDS, tenant_id=data.TENANT, project_id=data.PROJECT,
                      key_id=data.KEY["b"], recorded_at=data.NOW, tamper_at=501)
