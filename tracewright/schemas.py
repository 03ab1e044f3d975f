"""Explicit schemas; nothing is inferred."""
from pyspark.sql import types as T

_s, _l, _i, _b = T.StringType(), T.LongType(), T.IntegerType(), T.BinaryType()

STREAM_KEY = ["tenant_id", "project_id", "stream"]
CONTEXT_KEY = ["ctx_tenant_id", "ctx_project_id", "ctx_stream"]
INDEX_COLUMNS = ["actor_type", "actor_id", "action", "resource_type", "resource_id", "occurred_at"]
HEADER_COLUMNS = ["schema_version", "tenant_id", "project_id", "stream", "sequence", "event_id",
                  "recorded_at", "previous_hash", "payload_hash", "key_id"]

EVENTS = T.StructType([
    T.StructField("tenant_id", _s), T.StructField("project_id", _s), T.StructField("stream", _s),
    T.StructField("sequence", _l), T.StructField("schema_version", _i), T.StructField("event_id", _s),
    T.StructField("recorded_at", _s), T.StructField("previous_hash", _s), T.StructField("payload_hash", _s),
    T.StructField("key_id", _s), T.StructField("event_hash", _s), T.StructField("signature", _b),
    T.StructField("content", _s),
    *[T.StructField(c, _s) for c in INDEX_COLUMNS],
])

STREAMS = T.StructType([
    T.StructField("tenant_id", _s), T.StructField("project_id", _s), T.StructField("stream", _s),
    T.StructField("head_sequence", _l), T.StructField("head_hash", _s), T.StructField("head_recorded_at", _s),
    T.StructField("last_checkpoint_sequence", _l),
])

CHECKPOINTS = T.StructType([
    T.StructField("schema_version", _i), T.StructField("checkpoint_id", _s), T.StructField("tenant_id", _s),
    T.StructField("project_id", _s), T.StructField("stream", _s), T.StructField("sequence", _l),
    T.StructField("head_hash", _s), T.StructField("created_at", _s), T.StructField("key_id", _s),
    T.StructField("checkpoint_hash", _s), T.StructField("signature", _b),
])

KEYS = T.StructType([
    T.StructField("tenant_id", _s), T.StructField("project_id", _s), T.StructField("key_id", _s),
    T.StructField("algorithm", _s), T.StructField("public_key", _b), T.StructField("fingerprint", _s),
    T.StructField("status", _s), T.StructField("activated_at", _s), T.StructField("retired_at", _s),
    T.StructField("revoked_at", _s),
])

CHANGE = T.StructType([T.StructField("op", _s), T.StructField("path", _s),
                       T.StructField("from", _s), T.StructField("to", _s)])

EMISSION = T.StructType([T.StructField("phase", _i), T.StructField("batch", _l), T.StructField("sub", _i),
                         T.StructField("ordinal", _l), T.StructField("rank", _i)])

FINDINGS = T.StructType([
    T.StructField("tenant_id", _s), T.StructField("project_id", _s), T.StructField("stream", _s),
    T.StructField("code", _s), T.StructField("check", _s), T.StructField("severity", _s),
    T.StructField("sequence", _l), T.StructField("event_id", _s), T.StructField("message", _s),
    T.StructField("expected", _s), T.StructField("found", _s), T.StructField("emission", EMISSION),
])

# JSON line forms (member names of the wire format).
RECORD_JSON = T.StructType([
    T.StructField("schemaVersion", _i), T.StructField("tenantId", _s), T.StructField("projectId", _s),
    T.StructField("stream", _s), T.StructField("sequence", _l), T.StructField("eventId", _s),
    T.StructField("recordedAt", _s), T.StructField("previousHash", _s), T.StructField("payloadHash", _s),
    T.StructField("keyId", _s), T.StructField("eventHash", _s), T.StructField("signature", _s),
    T.StructField("content", _s),
])
CHECKPOINT_JSON = T.StructType([
    T.StructField("schemaVersion", _i), T.StructField("checkpointId", _s), T.StructField("tenantId", _s),
    T.StructField("projectId", _s), T.StructField("stream", _s), T.StructField("sequence", _l),
    T.StructField("headHash", _s), T.StructField("createdAt", _s), T.StructField("keyId", _s),
    T.StructField("checkpointHash", _s), T.StructField("signature", _s),
])
KEY_JSON = T.StructType([
    T.StructField("keyId", _s), T.StructField("algorithm", _s), T.StructField("publicKey", _s),
    T.StructField("fingerprint", _s), T.StructField("tenantId", _s), T.StructField("projectId", _s),
    T.StructField("status", _s), T.StructField("activatedAt", _s), T.StructField("retiredAt", _s),
    T.StructField("revokedAt", _s),
])
