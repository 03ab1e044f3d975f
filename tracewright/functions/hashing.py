"""Tagged hashes and header texts, all JVM side and inside codegen."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracewright.config import (HASH_PATTERN, ID_PATTERN, KEY_ID_PATTERN, MAX_SEQUENCE, SCHEMA_VERSION,
                                STREAM_PATTERN, ZERO_HASH, Tags)
from tracewright.functions.canon import json_string
from tracewright.functions.times import canonical_time_ok

_PLAIN = r"^[\x20\x21\x23-\x5b\x5d-\x7e]*\z"


def tagged_hash(tag: str, data: Column) -> Column:
    """hex SHA-256(tag, 00, data)."""
    lead = F.lit(bytearray(tag.encode() + b"\0"))
    return F.sha2(F.concat(lead, data.cast("binary")), 256)


def payload_hash(content: Column, tags: Tags) -> Column:
    return tagged_hash(tags.payload, content)


_BEFORE_LINK = ("event_id", "key_id", "payload_hash")
_AFTER_LINK = ("project_id", "recorded_at", "stream", "tenant_id")


def _escaping(c, names, build) -> Column:
    """build(quote) with plain quotes where no text needs escaping - one test for
    all of them - and with full escaping otherwise."""
    plain = F.concat(*[c(n) for n in names]).rlike(_PLAIN)
    simple = build(lambda n: F.concat(F.lit('"'), c(n), F.lit('"')))
    return F.when(plain, simple).otherwise(build(lambda n: json_string(c(n))))


def _before(c, q) -> list:
    return [F.lit('{"eventId":'), q("event_id"), F.lit(',"keyId":'), q("key_id"), F.lit(',"payloadHash":'),
            q("payload_hash"), F.lit(',"previousHash":"')]


def _after(c, q) -> list:
    return [F.lit('","projectId":'), q("project_id"), F.lit(',"recordedAt":'), q("recorded_at"),
            F.lit(',"schemaVersion":'), c("schema_version").cast("string"), F.lit(',"sequence":'),
            c("sequence").cast("string"), F.lit(',"stream":'), q("stream"), F.lit(',"tenantId":'), q("tenant_id"), F.lit("}")]


def header_before_link(c=F.col) -> Column:
    """Canonical header text up to the previous hash."""
    return _escaping(c, _BEFORE_LINK, lambda q: F.concat(*_before(c, q)))


def header_after_link(c=F.col) -> Column:
    """Canonical header text after the previous hash."""
    return _escaping(c, _AFTER_LINK, lambda q: F.concat(*_after(c, q)))


def header_canonical(c=F.col) -> Column:
    names = (*_BEFORE_LINK, "previous_hash", *_AFTER_LINK)
    return _escaping(c, names, lambda q: F.concat(
        *_before(c, q)[:-1], F.lit(',"previousHash":'), q("previous_hash"), F.lit(',"projectId":'),
        *_after(c, q)[1:]))


def event_hash(tags: Tags, c=F.col) -> Column:
    return tagged_hash(tags.event, header_canonical(c))


def checkpoint_canonical(c=F.col) -> Column:
    names = ("checkpoint_id", "created_at", "head_hash", "key_id", "project_id", "stream", "tenant_id")
    return _escaping(c, names, lambda q: F.concat(
        F.lit('{"checkpointId":'), q("checkpoint_id"), F.lit(',"createdAt":'), q("created_at"), F.lit(',"headHash":'),
        q("head_hash"), F.lit(',"keyId":'), q("key_id"), F.lit(',"projectId":'), q("project_id"), F.lit(',"schemaVersion":'),
        c("schema_version").cast("string"), F.lit(',"sequence":'), c("sequence").cast("string"), F.lit(',"stream":'),
        q("stream"), F.lit(',"tenantId":'), q("tenant_id"), F.lit("}")))


def checkpoint_hash(tags: Tags, c=F.col) -> Column:
    return tagged_hash(tags.checkpoint, checkpoint_canonical(c))


def hash_text_ok(col: Column) -> Column:
    return F.coalesce(col.rlike(HASH_PATTERN), F.lit(False))


def header_error(c=F.col) -> Column:
    """First reason why a header is malformed, or null."""
    def bad(name: str, pattern: str, label: str):
        return (~F.coalesce(c(name).rlike(pattern), F.lit(False)),
                F.concat(F.lit(f"invalid {label} "), F.coalesce(c(name), F.lit(""))))

    rules = [
        (~c("schema_version").eqNullSafe(SCHEMA_VERSION),
         F.concat(F.lit("unsupported schema version "), c("schema_version").cast("string"))),
        bad("tenant_id", ID_PATTERN, "tenant id"),
        bad("project_id", ID_PATTERN, "project id"),
        bad("stream", STREAM_PATTERN, "stream name"),
        ((c("sequence") < 1) | (c("sequence") > MAX_SEQUENCE),
         F.concat(F.lit("sequence "), c("sequence").cast("string"), F.lit(" out of range"))),
        bad("event_id", ID_PATTERN, "event id"),
        bad("key_id", KEY_ID_PATTERN, "key id"),
        (~canonical_time_ok(c("recorded_at")),
         F.concat(F.lit("timestamp "), F.coalesce(c("recorded_at"), F.lit("")), F.lit(" is not in canonical form"))),
        ((c("sequence") == 1) & (c("previous_hash") != ZERO_HASH),
         F.lit("the first event of a stream must have the zero previous hash")),
    ]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out


def checkpoint_error(c=F.col) -> Column:
    """Reason why a checkpoint body cannot be hashed, or null."""
    return (F.when(~c("schema_version").eqNullSafe(SCHEMA_VERSION), F.concat(
                F.lit("unsupported checkpoint schema version "), c("schema_version").cast("string")))
            .when(c("sequence") < 1, F.lit("checkpoint sequence must be positive"))
            .when(~F.coalesce(c("stream").rlike(STREAM_PATTERN), F.lit(False)),
                  F.concat(F.lit("invalid stream name "), c("stream")))
            .when(~canonical_time_ok(c("created_at")),
                  F.concat(F.lit("timestamp "), c("created_at"), F.lit(" is not in canonical form"))))


def key_fingerprint(public_key: Column) -> Column:
    return F.sha2(public_key, 256)


def key_id(public_key: Column) -> Column:
    return F.concat(F.lit("ed25519:"), F.substring(F.sha2(public_key, 256), 1, 32))
