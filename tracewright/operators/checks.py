"""The checks of one record, as column expressions that yield findings.

Each check is a nullable finding struct. Sparse arrays of findings travel with
narrow rows, so no check needs its own pass or a union.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.config import MAX_SEQUENCE, SCHEMA_VERSION, STORED, ZERO_HASH, VerifyOptions
from tracewright.functions import hashing
from tracewright.functions.canon import Rejected, StrictJson, dump
from tracewright.functions.crypto import verify_hex
from tracewright.functions.times import canonical_time_ok
from tracewright.schemas import CONTEXT_KEY, INDEX_COLUMNS

# Finding codes and the category each belongs to.
CATEGORY = {
    "unsupported_schema_version": "hashChain",
    "malformed_record": "hashChain",
    "context_mismatch": "hashChain",
    "payload_missing": "payloadHashes",
    "payload_invalid": "payloadHashes",
    "payload_not_canonical": "payloadHashes",
    "payload_hash_mismatch": "payloadHashes",
    "indexed_field_mismatch": "payloadHashes",
    "event_hash_mismatch": "hashChain",
    "unknown_signing_key": "signatures",
    "signature_invalid": "signatures",
    "signing_key_invalid": "signatures",
    "signing_key_revoked": "signatures",
    "signing_key_outside_validity": "signatures",
    "sequence_gap": "ordering",
    "sequence_out_of_order": "ordering",
    "previous_hash_mismatch": "hashChain",
    "anchor_mismatch": "hashChain",
    "timestamp_regression": "ordering",
    "head_mismatch": "streamHead",
    "checkpoint_invalid": "checkpoints",
    "checkpoint_mismatch": "checkpoints",
    "checkpoint_beyond_head": "checkpoints",
    "package_malformed": "package",
    "package_digest_mismatch": "package",
    "manifest_signature_invalid": "package",
    "package_unanchored": "package",
    "disclosure_mismatch": "package",
    "selection_mismatch": "package",
}
CATEGORIES = ["package", "hashChain", "payloadHashes", "signatures", "ordering", "checkpoints", "streamHead"]

FOUND = ("struct<code:string,severity:string,sequence:bigint,event_id:string,message:string,"
         "expected:string,found:string,rank:int>")


def category_of(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])[code]


def finding(code: str, when: Column, rank: int, message, expected=None, found=None, severity: str = "error",
            sequence: Column | str = "sequence", event_id: Column | str | None = "event_id") -> Column:
    def text(value):
        return F.lit(None).cast("string") if value is None else \
            (F.lit(value) if isinstance(value, str) else value.cast("string"))

    return F.when(when, F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"),
        (F.col(sequence) if isinstance(sequence, str) else sequence).cast("long").alias("sequence"),
        (F.lit(None).cast("string") if event_id is None else F.col(event_id) if isinstance(event_id, str) else event_id)
        .alias("event_id"),
        text(message).alias("message"), text(expected).alias("expected"), text(found).alias("found"),
        F.lit(rank).alias("rank")))


def _shape_error(tree) -> str | None:
    """Why a tree is not event content, judged by the members readers know."""
    if tree is None:
        return None

    def texts(node, names, label):
        if node is not None and not isinstance(node, dict):
            return f"{label} is not an object"
        return next((f"{label}.{n} is not a string" for n in names
                     if not isinstance((node or {}).get(n), (str, type(None)))), None)

    error = texts(tree, ("action", "occurredAt"), "content")
    if error is None:
        error = (texts(tree.get("actor"), ("type", "id", "displayName"), "actor")
                 or texts(tree.get("resource"), ("type", "id", "displayName"), "resource")
                 or texts(tree.get("context"), ("requestId", "traceId", "sessionId", "sourceIp", "userAgent"), "context"))
    for name in ("changes", "redactions"):
        items = tree.get(name) if error is None else None
        if items is not None and not isinstance(items, list):
            error = f"{name} is not an array"
        for item in items if error is None and items else ():
            bad = texts(item, ("op", "path"), "change") if name == "changes" else \
                (None if isinstance(item, (str, type(None))) else "redaction is not a string")
            error = error or bad
    return error


_NO_INDEX = (None,) * len(INDEX_COLUMNS)


def _index_texts(tree: dict) -> tuple:
    actor, resource = tree.get("actor") or {}, tree.get("resource") or {}
    values = (actor.get("type"), actor.get("id"), tree.get("action"), resource.get("type"), resource.get("id"),
              tree.get("occurredAt"))
    return tuple(value or "" for value in values)


def read_payload(options: VerifyOptions) -> Column:
    """One Arrow pass per record: parse strictly, compare with the canonical
    form, check the content's shape, verify the signature.

    canonical is set only where it differs from the stored text.
    """
    tag, signatures = options.tags.event_signature, options.signatures

    @F.pandas_udf("error string, canonical string, shape_error string, signature_ok boolean, "
                  + ", ".join(f"{name} string" for name in INDEX_COLUMNS))
    def run(contents: pd.Series, digests: pd.Series, keys: pd.Series, marks: pd.Series) -> pd.DataFrame:
        reader = StrictJson(STORED)
        errors, others, shapes, signed, indexes = [], [], [], [], []
        for content, digest, key, mark in zip(contents, digests, keys, marks):
            error = other = shape = None
            index = _NO_INDEX
            if content:
                raw = bytes(content)
                try:
                    tree, plain = reader.parse(raw)
                    text = reader.encode(tree, plain)
                    if text.encode() != raw:
                        other = text
                    shape = _shape_error(tree)
                    if shape is None:
                        index = _index_texts(tree or {})
                except Rejected as err:
                    error = str(err)
            errors.append(error)
            others.append(other)
            shapes.append(shape)
            indexes.append(index)
            signed.append(verify_hex(tag, digest, key, mark) if signatures and key is not None else None)
        columns = {"error": errors, "canonical": others, "shape_error": shapes, "signature_ok": signed,
                   **dict(zip(INDEX_COLUMNS, zip(*indexes)))}
        return pd.DataFrame({name: pd.Series(list(values), dtype=object) for name, values in columns.items()})

    return run(F.col("content").cast("binary"), F.col("event_hash"), F.col("key_public"), F.col("signature"))


def index_fields(content: Column) -> dict[str, Column]:
    """The six index values of canonical content; absent members are ''."""
    view = F.from_json(content, "action string, actor struct<type:string,id:string>, "
                                "resource struct<type:string,id:string>, occurredAt string")
    paths = {"actor_type": "actor.type", "actor_id": "actor.id", "action": "action", "resource_type": "resource.type",
             "resource_id": "resource.id", "occurred_at": "occurredAt"}
    out = {}
    for name, path in paths.items():
        value = view
        for step in path.split("."):
            value = value[step]
        out[name] = F.coalesce(value, F.lit(""))
    return out


def index_diff(signed, stored=lambda n: F.coalesce(F.col(n), F.lit(""))) -> Column:
    """array<struct<name,expected,found>> of differing index columns, in fixed order."""
    return F.array_compact(F.array(*[
        F.when(signed(n) != stored(n), F.struct(F.lit(n).alias("name"), signed(n).alias("expected"),
                                                stored(n).alias("found")))
        for n in INDEX_COLUMNS]))


def check_records(records: DataFrame, options: VerifyOptions) -> DataFrame:
    """Narrow rows with ``found``: the findings every record has on its own.

    ``records``: record columns, the verified context (ctx_*), and the key
    columns of operators.keys.with_key.
    """
    supported = F.col("schema_version").eqNullSafe(SCHEMA_VERSION)
    has_content = F.coalesce(F.length("content") > 0, F.lit(False))
    read = records.withColumn("_read", read_payload(options)) \
        .withColumn("_canonical", F.coalesce("_read.canonical", F.col("content"))) \
        .withColumn("_payload_hash", hashing.payload_hash(F.col("_canonical"), options.tags)) \
        .withColumn("_event_hash", hashing.event_hash(options.tags)) \
        .withColumn("_time_ok", canonical_time_ok(F.col("recorded_at"))) \
        .withColumn("_usage", F.when(~F.col("_time_ok"), F.lit(None))
                    .when(F.col("recorded_at") > F.col("key_unrevoked_until"), F.lit("after_revocation"))
                    .when(F.col("recorded_at") < F.col("key_valid_from"), F.lit("before_activation"))
                    .when(F.col("recorded_at") > F.col("key_valid_until"), F.lit("after_retirement")))
    valid = supported & has_content & F.col("_read.error").isNull()
    intact = valid & F.col("_payload_hash").eqNullSafe(F.col("payload_hash"))
    checks = [
        finding("payload_missing", supported & ~has_content & F.lit(options.require_content), 10,
                "this record has no content"),
        finding("payload_invalid", supported & has_content & F.col("_read.error").isNotNull(), 11,
                F.concat(F.lit("content cannot be parsed: "), F.col("_read.error"))),
        finding("payload_not_canonical",
                valid & F.col("_read.canonical").isNotNull() & F.lit(options.require_canonical), 12,
                "content parses, but is not written canonically"),
        finding("payload_hash_mismatch", valid & ~intact, 13,
                "hashing the content gives another value than the header holds", F.col("payload_hash"), F.col("_payload_hash")),
    ]
    if options.check_index:
        read = read.withColumn("_differing", F.when(intact, index_diff(lambda n: F.col(f"_read.{n}"))))
        first = F.get("_differing", F.lit(0))
        shaped = F.col("_read.shape_error").isNull()
        checks += [
            finding("payload_invalid", intact & ~shaped, 14,
                    F.concat(F.lit("content lacks the members of an event: "), F.col("_read.shape_error"))),
            finding("indexed_field_mismatch", intact & shaped & F.coalesce(F.size("_differing") > 0, F.lit(False)), 15,
                    F.concat(F.lit("columns that disagree with the content: "), F.array_join(F.transform("_differing", lambda d: d["name"]), ", ")), first["expected"], first["found"]),
        ]
    untrusted = F.col("key_public").isNull()
    context = F.concat_ws("/", *CONTEXT_KEY)
    own = F.concat_ws("/", "tenant_id", "project_id", "stream")
    hashable = F.col("sequence").between(-MAX_SEQUENCE, MAX_SEQUENCE)
    checks += [
        finding("unsupported_schema_version", ~supported, 20,
                F.concat(F.lit("unknown record version "), F.col("schema_version").cast("string")), str(SCHEMA_VERSION), F.col("schema_version")),
        finding("context_mismatch", supported & (context != own), 21,
                "header and storage place name different chains", context, own),
        finding("malformed_record", supported & ~hashable, 22,
                F.concat(F.lit("no header hash for sequence "), F.col("sequence").cast("string"),
                         F.lit(": its magnitude is over 2^53"))),
        finding("event_hash_mismatch", supported & hashable & ~F.col("_event_hash").eqNullSafe(F.col("event_hash")), 23,
                "hashing the header gives another value than the record holds", F.col("event_hash"), F.col("_event_hash")),
        finding("malformed_record", supported & ~F.col("_time_ok"), 24,
                F.concat(F.lit("recorded time is not written canonically: "), F.coalesce("recorded_at", F.lit(""))),
                None, F.col("recorded_at")),
        finding("unknown_signing_key", supported & untrusted, 30,
                F.concat(F.lit("no trusted key is called "), F.coalesce("key_id", F.lit("(none)")),
                         F.lit("; the record is forged or the key is missing from the set")),
                None, F.col("key_id")),
        finding("signature_invalid", supported & ~untrusted & ~F.coalesce("_read.signature_ok", F.lit(False))
                & F.lit(options.signatures), 31,
                F.concat(F.lit("bad signature for key "), F.col("key_id"))),
        finding("signing_key_revoked", supported & ~untrusted & (F.col("_usage") == "after_revocation"), 32,
                F.concat(F.lit("key "), F.col("key_id"), F.lit(" had been revoked at "),
                         F.col("key_revoked_at")), F.col("key_revoked_at"), F.col("recorded_at")),
        finding("signing_key_outside_validity", supported & ~untrusted & (F.col("_usage") == "before_activation"), 40,
                F.concat(F.lit("key "), F.col("key_id"), F.lit(" starts only at "),
                         F.col("key_activated_at")), severity="warning"),
        finding("signing_key_outside_validity", supported & ~untrusted & (F.col("_usage") == "after_retirement"), 41,
                F.concat(F.lit("key "), F.col("key_id"), F.lit(" had ended at "),
                         F.col("key_retired_at")), severity="warning"),
    ]
    return read.withColumn("found", F.array_compact(F.array(*checks))) \
        .withColumn("known_time", F.when(supported & F.col("_time_ok"), F.col("recorded_at"))) \
        .withColumn("has_content", has_content)


def check_order(rows: DataFrame) -> DataFrame:
    """Add the findings that need the preceding record.

    ``rows``: as from check_records, with prev_sequence, prev_event_hash,
    prev_known_time, is_first and the anchor columns.
    """
    before = F.when(F.col("is_first"), F.col("anchor_sequence")).otherwise(F.col("prev_sequence"))
    link = F.when(F.col("is_first"), F.col("anchor_hash")).otherwise(F.col("prev_event_hash"))
    due = before + 1
    broken = ~F.col("previous_hash").eqNullSafe(link)
    early = F.array(
        finding("sequence_gap", F.col("sequence") > due, 1, F.format_string(
            "after sequence %d comes %d; absent in between: %d", before, F.col("sequence"), F.col("sequence") - due),
            due, F.col("sequence")),
        finding("sequence_out_of_order", F.col("sequence") < due, 1, F.format_string(
            "sequence %d stands behind sequence %d: repeated or moved", F.col("sequence"), before),
            due, F.col("sequence")),
        finding("anchor_mismatch", broken & F.col("is_first"), 2,
                F.concat(F.lit("the chain's first record does not follow its anchor: "), F.col("anchor_description")), link, F.col("previous_hash")),
        finding("previous_hash_mismatch", broken & ~F.col("is_first"), 2,
                F.when(F.col("previous_hash") == ZERO_HASH, F.lit(
                    "this record claims to be a chain's first (its previous hash is the genesis value), but is not")).otherwise(F.format_string(
                        "the previous hash is not that of the record before, sequence %d;", before)),
                link, F.col("previous_hash")))
    late = F.array(finding(
        "timestamp_regression", F.col("known_time") < F.col("prev_known_time"), 50,
        "time runs backwards from the record before",
        F.concat(F.lit(">= "), F.col("prev_known_time")), F.col("recorded_at")))
    return rows.withColumn("found", F.array_compact(F.concat(early, F.col("found"), late)))
