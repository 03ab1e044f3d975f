"""SQL over the given tables that the registered queries are compared with."""
from __future__ import annotations

from tracewright.config import ZERO_HASH
from tracewright.sources.audit_view import PROJECT, TENANT
from tracewright.suite.data import KEY, ROTATED, TAGS

STAMP = "%Y-%m-%dT%H:%M:%S.%fZ"


def tagged(tag: str, text: str) -> str:
    return f"sha256(encode('{tag}') || '\\x00'::BLOB || encode({text}))"


AV = f"""av AS (SELECT '{TENANT}' AS tenant_id, '{PROJECT}' AS project_id, event_type AS stream,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sequence,
  'evt_' || lpad(CAST(event_id AS VARCHAR), 26, '0') AS event_id,
  strftime(ts, '{STAMP}') AS recorded_at, ts,
  '{{"action":"' || event_type || '","actor":{{"id":"user_' || user_id || '","type":"user"}},"data":'
    || replace(props, ' ', '') || '}}' AS content,
  'user' AS actor_type, 'user_' || user_id AS actor_id, event_type AS action, replace(props, ' ', '') AS data,
  CASE WHEN strftime(ts, '{STAMP}') < '{ROTATED}' THEN '{KEY["a"]}' ELSE '{KEY["b"]}' END AS key_id
  FROM events)"""

PAYLOAD = AV + f""",
hashed AS (SELECT *, {tagged(TAGS.payload, "content")} AS payload_hash FROM av)"""


def header(previous: str, a: str = "h") -> str:
    return (f"""'{{"eventId":"' || {a}.event_id || '","keyId":"' || {a}.key_id || '","payloadHash":"' || """
            f"""{a}.payload_hash || '","previousHash":"' || {previous} || '","projectId":"' || {a}.project_id || """
            f"""'","recordedAt":"' || {a}.recorded_at || '","schemaVersion":1,"sequence":' || {a}.sequence || """
            f"""',"stream":"' || {a}.stream || '","tenantId":"' || {a}.tenant_id || '"}}'""")


def linked(source: str = "hashed") -> str:
    return f"""links AS (
  SELECT h.stream, h.sequence, '{ZERO_HASH}' AS previous_hash, {tagged(TAGS.event, header(f"'{ZERO_HASH}'"))} AS event_hash
  FROM {source} h WHERE h.sequence = 1
  UNION ALL
  SELECT h.stream, h.sequence, l.event_hash, {tagged(TAGS.event, header("l.event_hash"))}
  FROM links l JOIN {source} h ON h.stream = l.stream AND h.sequence = l.sequence + 1),
chain AS (SELECT h.*, l.previous_hash, l.event_hash FROM {source} h JOIN links l USING (stream, sequence))"""


CHAIN = "WITH RECURSIVE " + PAYLOAD + ", " + linked()
WITH_AV = "WITH " + AV

HEADS = AV + """,
heads AS (SELECT tenant_id, project_id, stream, max(sequence) AS head_sequence, max(recorded_at) AS head_recorded_at,
  coalesce(max(sequence) FILTER (WHERE sequence % 50 = 0), 0) AS last_checkpoint_sequence
  FROM av GROUP BY ALL)"""

# The tampered chain: what each record is, after the mutations of suite/data.py.
PRESENT = HEADS + """,
kept AS (SELECT a.*, a.sequence % 100 AS r, h.head_sequence AS n, h.head_sequence - 3 AS last
  FROM av a JOIN heads h USING (stream) WHERE a.sequence <= h.head_sequence - 3),
moved AS (SELECT *, sequence AS old, (r = 43 AND sequence < last) OR r = 44 AS swapped FROM kept WHERE r <> 37),
present AS (SELECT * REPLACE (CASE WHEN r = 44 THEN sequence - 1 WHEN swapped THEN sequence + 1 ELSE sequence END AS sequence,
    CASE r WHEN 13 THEN '2023-06-01T00:00:00.000000Z' WHEN 47 THEN replace(recorded_at, 'T', ' ') ELSE recorded_at END
      AS recorded_at), 1 AS copy FROM moved
  UNION ALL SELECT *, 2 AS copy FROM moved WHERE r = 53),
tails AS (SELECT stream, max(sequence) AS tail, max(n) AS n FROM present GROUP BY stream)"""

# The runs over the clean and the tampered chain, as far as listings need them.
FIRST_BAD = """first_bad AS (SELECT stream, CASE WHEN last >= 3 THEN 3 END AS first_failure_sequence, tail AS last_sequence
  FROM (SELECT stream, max(last) AS last FROM kept GROUP BY stream) JOIN tails USING (stream))"""

#: The id of a key whose public part is the SHA-256 of a text.
KEY_OF = "'ed25519:' || substr(sha256(unhex(sha256({}))), 1, 32)"
