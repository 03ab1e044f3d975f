"""Column functions: canonical text, hashes, keys, diffs, redaction, validation."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.config import INGEST, STORED, Settings
from tracewright.functions import crypto, hashing, states, times
from tracewright.functions.canon import canonicalize, json_string, request_hash
from tracewright.operators import keys as key_ops, listing
from tracewright.operators.checks import index_diff, index_fields
from tracewright.plans import prepare as prep
from tracewright.suite import data
from tracewright.suite.registry import query
from tracewright.suite.sql import CHAIN, PAYLOAD, PRESENT, STAMP, WITH_AV, header, tagged


def _untidy():
    """The content of activity rows with spaces and in another member order."""
    return F.concat(F.lit('{ "data" : '), F.col("props"), F.lit(', "actor" : { "type" : "user" , "id" : "user_'),
                    F.col("user_id").cast("string"), F.lit('" } , "action" : "'), F.col("event_type"), F.lit('" }'))




@query("p01_canonicalize", WITH_AV + " SELECT event_id, content AS canonical, true AS accepted FROM av")
def p01(spark, sf):
    rows = data.raw(spark, sf, "events").select(
        F.concat(F.lit("evt_"), F.lpad(F.col("event_id").cast("string"), 26, "0")).alias("event_id"), _untidy().alias("text"))
    return rows.withColumn("c", canonicalize(F.col("text"), STORED)).select(
        "event_id", F.col("c.canonical").alias("canonical"), F.col("c.error").isNull().alias("accepted"))


@query("p01_canonicalize_texts", """SELECT doc_id, '{"lang":' || CAST(to_json(lang) AS VARCHAR) || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}' AS canonical
  FROM documents""")
def p01_texts(spark, sf):
    # Whole texts, written by Spark's JSON writer with the members reversed.
    rows = data.raw(spark, sf, "documents").select("doc_id", F.to_json(F.struct("text", "lang")).alias("json"))
    return rows.select("doc_id", canonicalize(F.col("json"), STORED)["canonical"].alias("canonical"))


@query("p01_reject_duplicates", "SELECT event_id, event_id % 4 <> 0 AS accepted FROM events")
def p01_reject(spark, sf):
    # Every fourth text repeats a member, is cut off, has trailing data or a bad number.
    n = F.col("event_id")
    bad = F.when(n % 16 == 0, F.lit('{"a":1,"a":2}')).when(n % 16 == 4, F.lit('{"a":1')).when(n % 16 == 8, F.lit("{} {}")) \
        .when(n % 16 == 12, F.lit('{"a":01}')).otherwise(F.col("props"))
    return data.raw(spark, sf, "events").select("event_id", canonicalize(bad, STORED)["error"].isNull().alias("accepted"))


@query("p01_integral_numbers", """SELECT o_orderkey, '[' || (9007199254740992 + 2 * o_orderkey) || ',' || (9000000000000000 + 8 * o_orderkey) || ',-' ||
  (9500000000000000 + 2 * o_orderkey) || ',' || (o_orderkey * 1000000) || ']' AS canonical FROM orders""")
def p01_integral(spark, sf):
    # Integers around and above 2^53 that binary64 holds exactly, with a fraction, an exponent, a sign.
    n = F.col("o_orderkey").cast("long")
    text = F.concat(F.lit("[ "), (n * 2 + 9007199254740992).cast("string"), F.lit(".0, "), (n * 8 + 9000000000000000).cast("string"), F.lit(" ,-"),
                    (n * 2 + 9500000000000000).cast("string"), F.lit(".00,"), n.cast("string"), F.lit("e6]"))
    return data.raw(spark, sf, "orders").select("o_orderkey", canonicalize(text, STORED)["canonical"].alias("canonical"))


@query("p02_ingest_profile", "SELECT event_id, event_id % 4 = 3 AS accepted FROM events")
def p02(spark, sf):
    n = F.col("event_id")
    text = F.when(n % 4 == 0, F.concat(F.lit('{"n":90071992547409930'), n.cast("string"), F.lit("}"))) \
        .when(n % 4 == 1, F.lit('{"s":"a\\u0000b"}')).when(n % 4 == 2, F.concat(F.repeat(F.lit("["), F.lit(41)), F.repeat(F.lit("]"), F.lit(41)))) \
        .otherwise(F.col("props"))
    return data.raw(spark, sf, "events").select("event_id", canonicalize(text, INGEST)["error"].isNull().alias("accepted"))


@query("p03_request_hash", WITH_AV + " SELECT event_id, sha256(content) AS request_hash FROM av")
def p03(spark, sf):
    return data.raw(spark, sf, "events").select(
        F.concat(F.lit("evt_"), F.lpad(F.col("event_id").cast("string"), 26, "0")).alias("event_id"),
        request_hash(_untidy()).alias("request_hash"))


@query("p04_tagged_hash", f"SELECT doc_id, {tagged('some:tag', 'text')} AS digest FROM documents")
def p04(spark, sf):
    return data.raw(spark, sf, "documents").select("doc_id", hashing.tagged_hash("some:tag", F.col("text")).alias("digest"))


@query("p05_payload_hash", "WITH " + PAYLOAD + " SELECT event_id, payload_hash FROM hashed")
def p05(spark, sf):
    return data.submitted(spark, sf).select("event_id", hashing.payload_hash(F.col("content"), data.TAGS).alias("payload_hash"))


@query("p06_header_canonical", CHAIN + f" SELECT event_id, {header('h.previous_hash')} AS header FROM chain h")
def p06(spark, sf):
    return data.chain(spark, sf).select("event_id", hashing.header_canonical().alias("header"))


@query("p06_json_string", "SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS quoted FROM documents")
def p06_string(spark, sf):
    return data.raw(spark, sf, "documents").select("doc_id", json_string(F.col("text")).alias("quoted"))


@query("p07_event_hash", CHAIN + " SELECT event_id, event_hash FROM chain")
def p07(spark, sf):
    return data.chain(spark, sf).select("event_id", hashing.event_hash(data.TAGS).alias("event_hash"))


@query("p08_validate_header", "WITH " + PRESENT + """ SELECT stream, sequence, error FROM (SELECT stream, sequence, CASE
  WHEN r = 41 THEN 'unsupported schema version 2'
  WHEN r = 47 THEN 'timestamp ' || recorded_at || ' is not in canonical form' END AS error FROM present) WHERE error IS NOT NULL""")
def p08(spark, sf):
    return data.tampered(spark, sf).select("stream", "sequence", hashing.header_error().alias("error")).where("error IS NOT NULL")


@query("p11_key_id", """SELECT c_custkey, sha256(c_name) AS fingerprint, 'ed25519:' || substr(sha256(c_name), 1, 32) AS key_id FROM customer""")
def p11(spark, sf):
    raw = F.col("c_name").cast("binary")
    return data.raw(spark, sf, "customer").select("c_custkey", hashing.key_fingerprint(raw).alias("fingerprint"),
                                                  hashing.key_id(raw).alias("key_id"))


@query("p12_validate_key", """SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'algorithm' WHEN 2 THEN 'length' WHEN 3 THEN 'id' END AS problem FROM customer""")
def p12(spark, sf):
    k = F.col("c_custkey")
    raw = F.unhex(F.sha2(F.col("c_name"), 256))
    rows = data.raw(spark, sf, "customer").select(
        "c_custkey", F.when(k % 4 == 1, F.lit("RSA")).otherwise(F.lit("Ed25519")).alias("algorithm"),
        F.when(k % 4 == 2, F.substring(raw, 1, 31)).otherwise(raw).alias("public_key"),
        F.when(k % 4 == 3, F.lit("ed25519:" + "0" * 32)).otherwise(hashing.key_id(raw)).alias("key_id"),
        F.lit("").alias("fingerprint"), F.lit(None).cast("string").alias("activated_at"),
        F.lit(None).cast("string").alias("retired_at"), F.lit(None).cast("string").alias("revoked_at"))
    reason = key_ops.key_error()
    return rows.select("c_custkey", F.when(reason.contains("algorithm"), F.lit("algorithm")).when(reason.contains("32 bytes"), F.lit("length"))
                       .when(reason.contains("does not match"), F.lit("id")).alias("problem"))


@query("p13_timestamps", f"""SELECT event_id, strftime(ts, '{STAMP}') AS text, event_id % 4 = 3 AS accepted FROM events""")
def p13(spark, sf):
    text = times.format_time(F.col("ts"))
    n = F.col("event_id")
    other = F.when(n % 4 == 0, F.replace(text, F.lit("T"), F.lit(" "))).when(n % 4 == 1, F.lit("2024-02-30T00:00:00.000000Z")) \
        .when(n % 4 == 2, F.concat(text, F.lit("\n"))).otherwise(text)
    return data.raw(spark, sf, "events").select("event_id", text.alias("text"), times.canonical_time_ok(other).alias("accepted"))


@query("p14_hash_text", CHAIN + " SELECT event_id, sequence % 3 = 0 AS accepted FROM chain")
def p14(spark, sf):
    text = F.when(F.col("sequence") % 3 == 1, F.upper("event_hash")).when(F.col("sequence") % 3 == 2, F.substring("event_hash", 1, 63)) \
        .otherwise(F.col("event_hash"))
    # A hash without letters is equal to its upper case; none of 2^64 digests is.
    return data.chain(spark, sf).select("event_id", hashing.hash_text_ok(text).alias("accepted"))


@query("p15_index_fields", WITH_AV + " SELECT event_id, actor_type, actor_id, action, '' AS resource_type, '' AS resource_id, '' AS occurred_at FROM av")
def p15(spark, sf):
    return data.chain(spark, sf).select("event_id", *[c.alias(n) for n, c in index_fields(F.col("content")).items()])


@query("p16_index_diff", "WITH " + PRESENT + """ SELECT event_id, copy, 'actor_id' AS names, actor_id AS expected, 'user_x' AS found FROM present WHERE r = 7""")
def p16(spark, sf):
    rows = data.tampered(spark, sf).where("content LIKE '{%'").withColumn("s", F.struct(
        *[c.alias(n) for n, c in index_fields(F.col("content")).items()])).withColumn("d", index_diff(lambda n: F.col(f"s.{n}")))
    shown = rows.where((F.size("d") > 0) & ~F.col("content").contains('"root"'))
    return shown.select("event_id", F.lit(1).alias("copy"), F.array_join(F.transform("d", lambda x: x["name"]), ",").alias("names"),
                        F.get("d", F.lit(0))["expected"].alias("expected"), F.get("d", F.lit(0))["found"].alias("found"))


_PAIRS = """pairs AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p,
    lag(o_orderkey) OVER w AS bk, lag(o_orderstatus) OVER w AS bs, lag(o_orderpriority) OVER w AS bp FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
_CHANGES = _PAIRS + """, changes AS (
  SELECT k, 'add' AS op, m.path, NULL AS "from", m.v AS "to" FROM pairs, LATERAL (VALUES ('/order', CAST(k AS VARCHAR)),
    ('/priority', '"' || p || '"'), ('/status', '"' || s || '"'), ('/token', '"tok-' || c || '"')) m(path, v) WHERE bk IS NULL
  UNION ALL SELECT k, 'replace', m.path, m.o, m.n FROM pairs, LATERAL (VALUES ('/order', CAST(bk AS VARCHAR), CAST(k AS VARCHAR)),
    ('/priority', '"' || bp || '"', '"' || p || '"'), ('/status', '"' || bs || '"', '"' || s || '"')) m(path, o, n)
    WHERE bk IS NOT NULL AND m.o <> m.n)"""


@query("p17_json_diff", "WITH " + _CHANGES + ' SELECT k, op, path, "from", "to" FROM changes')
def p17(spark, sf):
    rows = data.requests(spark, sf).select(F.col("o_orderkey").alias("k"), F.explode(states.json_diff(F.col("before"), F.col("after"))).alias("d"))
    return rows.select("k", "d.op", "d.path", "d.from", "d.to")


def _redacted(mode: str) -> str:
    token = {"redact": "'\"token\":\"[REDACTED]\"'", "mask": "'\"token\":\"' || masked || '\"'", "remove": None}[mode]
    tail = "" if token is None else " || ',' || " + token
    return f"""SELECT o_orderkey, '{{"order":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"'{tail} || '}}' AS json,
      '/after/token' AS redacted FROM (SELECT *, CASE WHEN length('tok-' || o_custkey) > 8 THEN repeat('*', length('tok-' || o_custkey) - 4)
      || right('tok-' || o_custkey, 4) ELSE repeat('*', length('tok-' || o_custkey)) END AS masked FROM orders)"""


for _mode in ("redact", "mask", "remove"):
    @query(f"p18_{_mode}_states", _redacted(_mode))
    def p18(spark, sf, mode=_mode):
        rows = data.requests(spark, sf).withColumn("x", states.redact(F.col("after"), "after", Settings(redact_mode=mode)))
        return rows.select("o_orderkey", F.col("x.json").alias("json"), F.array_join("x.redacted", ",").alias("redacted"))


@query("p19_redact_changes", "WITH " + _CHANGES + """ SELECT k, op, path, CASE WHEN path = '/priority' AND op = 'replace' THEN '"[REDACTED]"' ELSE "from" END AS "from",
  CASE WHEN path IN ('/token', '/priority') THEN '"[REDACTED]"' ELSE "to" END AS "to" FROM changes""")
def p19(spark, sf):
    # Tokens by their name, priorities by a configured path.
    changes = states.json_diff(F.col("before"), F.col("after"))
    rows = data.requests(spark, sf).withColumn("c", changes).select(
        F.col("o_orderkey").alias("k"), states.redact_changes(F.col("c"), Settings(redact_paths=("/after/priority",)))["changes"].alias("c"))
    return rows.select("k", F.explode("c").alias("d")).select("k", "d.op", "d.path", "d.from", "d.to")


@query("p20_mask", """SELECT c_custkey, CASE WHEN length(v) > 8 THEN repeat('*', length(v) - 4) || right(v, 4) ELSE repeat('*', length(v)) END AS masked
  FROM (SELECT c_custkey, substr(c_name, 1, CAST(c_custkey % 12 AS INTEGER)) AS v FROM customer)""")
def p20(spark, sf):
    text = F.substring(F.col("c_name"), F.lit(1), (F.col("c_custkey") % 12).cast("int"))
    return data.raw(spark, sf, "customer").select("c_custkey", states.mask(text).alias("masked"))


def _content_sql(diff_only: bool) -> str:
    first = """'"changes":[{"op":"add","path":"/order","to":' || k || '},{"op":"add","path":"/priority","to":"' || p || '"},{"op":"add","path":"/status","to":"' || s || '"},{"op":"add","path":"/token","to":"[REDACTED]"}]'"""
    later = """'"changes":[{"from":' || bk || ',"op":"replace","path":"/order","to":' || k || '}' || CASE WHEN bp <> p THEN ',{"from":"' || bp || '","op":"replace","path":"/priority","to":"' || p || '"}' ELSE '' END || CASE WHEN bs <> s THEN ',{"from":"' || bs || '","op":"replace","path":"/status","to":"' || s || '"}' ELSE '' END || ']'"""
    changes = f"CASE WHEN bk IS NULL THEN {first} ELSE {later} END"
    head = """'{"action":"order.updated","actor":{"id":"c' || c || '","type":"customer"}'"""
    after = """',"after":{"order":' || k || ',"priority":"' || p || '","status":"' || s || '","token":"[REDACTED]"}'"""
    before = """CASE WHEN bk IS NULL THEN ',"before":null' ELSE ',"before":{"order":' || bk || ',"priority":"' || bp || '","status":"' || bs || '","token":"[REDACTED]"}' END"""
    noted = "CASE WHEN bk IS NULL THEN ',\"redactions\":[\"/after/token\"]' ELSE ',\"redactions\":[\"/after/token\",\"/before/token\"]' END"
    if diff_only:
        noted = "CASE WHEN bk IS NULL THEN ',\"redactions\":[\"/after/token\"]' ELSE '' END"
    states_ = "" if diff_only else f" || {after} || {before}"
    resource = """',"resource":{"id":"o' || k || '","type":"order"}}'"""
    return f"WITH {_PAIRS} SELECT k, {head}{states_} || ',' || {changes} || {noted} || {resource} AS content FROM pairs"


@query("p24_prepare_content", _content_sql(False))
def p24(spark, sf):
    return prep.prepare(data.requests(spark, sf)).select(F.col("o_orderkey").alias("k"), "content")


@query("p21_retain_diff", _content_sql(True))
def p21(spark, sf):
    return prep.prepare(data.requests(spark, sf), Settings(retain_states="diff")).select(F.col("o_orderkey").alias("k"), "content")


@query("k01_prepare", f"WITH {_PAIRS} SELECT k, 'orders' AS stream, 'customer' AS actor_type, 'c' || c AS actor_id, 'order' AS resource_type, 'o' || k AS resource_id, 0 AS errors FROM pairs", longs="errors")
def k01(spark, sf):
    return prep.prepare(data.requests(spark, sf)).select(
        F.col("o_orderkey").alias("k"), "stream", "actor_type", "actor_id", "resource_type", "resource_id", F.size("errors").cast("long").alias("errors"))


@query("p22_occurred_at", f"""SELECT event_id, strftime(ts - CASE event_id % 3 WHEN 0 THEN INTERVAL 0 MINUTE WHEN 1 THEN INTERVAL 270 MINUTE ELSE -INTERVAL 120 MINUTE END, '{STAMP}') AS occurred_at
  FROM events""")
def p22(spark, sf):
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    n = F.col("event_id")
    text = F.concat(local, F.when(n % 3 == 0, F.lit("789Z")).when(n % 3 == 1, F.lit("+04:30")).otherwise(F.lit("-02:00")))
    return data.raw(spark, sf, "events").select("event_id", times.normalize_occurred_at(text).alias("occurred_at"))


@query("p25_size_guard", "SELECT doc_id, octet_length(encode(text)) > 4000 AS too_large FROM documents")
def p25(spark, sf):
    return data.raw(spark, sf, "documents").select("doc_id", prep.size_guard(F.col("text"), 65536, Settings(max_event_bytes=4000)).alias("too_large"))


@query("p26_render_event", WITH_AV + " SELECT event_id, stream, sequence, action, 'user' AS actor_type, actor_id, data FROM av")
def p26(spark, sf):
    return listing.render_event(data.chain(spark, sf)).select("event_id", "stream", "sequence", "action", F.col("actor.type").alias("actor_type"),
                                                              F.col("actor.id").alias("actor_id"), "data")


@query("p27_receipts", CHAIN + " SELECT event_id, sequence, payload_hash, event_hash, key_id, 88 AS signature_length FROM chain", longs="signature_length")
def p27(spark, sf):
    return listing.receipts(data.chain(spark, sf)).select("event_id", "sequence", "payload_hash", "event_hash", "key_id",
                                                          F.length("signature").cast("long").alias("signature_length"))


@query("p28_event_status", WITH_AV + """ SELECT event_id, CASE WHEN sequence > 150 THEN 'unverified' WHEN sequence >= 100 THEN 'failed'
  ELSE 'verified' END AS status FROM av""")
def p28(spark, sf):
    return data.chain(spark, sf).select("event_id", listing.event_status(F.col("sequence"), F.lit(150), F.lit(100)).alias("status"))


@query("p29_stream_status", WITH_AV + """ SELECT stream, CASE WHEN stream < 'error' THEN 'never' WHEN stream < 'signup' THEN 'passed' ELSE 'failed' END AS status
  FROM av GROUP BY stream""")
def p29(spark, sf):
    valid = F.when(F.col("stream") < "error", F.lit(None)).otherwise(F.col("stream") < "signup").cast("boolean")
    return data.streams(spark, sf).select("stream", listing.stream_status(valid).alias("status"))


_CP_BODY = f"""'{{"checkpointId":"chk_' || upper(substr(sha256(event_hash), 1, 26)) || '","createdAt":"' || recorded_at || '","headHash":"' || event_hash ||
  '","keyId":"{data.KEY["b"]}","projectId":"' || project_id || '","schemaVersion":1,"sequence":' || sequence || ',"stream":"' || stream ||
  '","tenantId":"' || tenant_id || '"}}'"""


@query("p30_checkpoint_hash", CHAIN + f" SELECT stream, sequence, {_CP_BODY} AS body, {tagged(data.TAGS.checkpoint, _CP_BODY)} AS checkpoint_hash FROM chain WHERE sequence % 50 = 0")
def p30(spark, sf):
    return data.checkpoints(spark, sf).select("stream", "sequence", hashing.checkpoint_canonical().alias("body"),
                                              hashing.checkpoint_hash(data.TAGS).alias("checkpoint_hash"))


@query("p31_key_usage", WITH_AV + """ SELECT event_id, CASE WHEN recorded_at > '2024-01-20T00:01:00.000000Z' THEN 'after_revocation'
  WHEN recorded_at < '2024-01-04T23:59:00.000000Z' THEN 'before_activation' WHEN recorded_at > '2024-01-10T00:01:00.000000Z' THEN 'after_retirement'
  ELSE 'valid' END AS usage FROM av""")
def p31(spark, sf):
    rows = data.chain(spark, sf).withColumns({"activated_at": F.lit("2024-01-05T00:00:00.000000Z"),
                                              "retired_at": F.lit("2024-01-10T00:00:00.000000Z"),
                                              "revoked_at": F.lit("2024-01-20T00:00:00.000000Z")})
    return rows.select("event_id", key_ops.key_usage(F.col("recorded_at"), 60).alias("usage"))


@query("p32_without_content", CHAIN + " SELECT event_id, event_hash, true AS withheld FROM chain")
def p32(spark, sf):
    return listing.without_content(data.chain(spark, sf)).select("event_id", "event_hash", F.col("content").isNull().alias("withheld"))


_BAD = """CASE o_orderkey % 8 WHEN 0 THEN 'stream' WHEN 1 THEN 'actor' WHEN 2 THEN 'actor.id' WHEN 3 THEN 'action' WHEN 4 THEN 'extra'
  WHEN 5 THEN 'metadata' WHEN 6 THEN 'context.sourceIp' ELSE '' END"""


def _faulty(spark, sf):
    n = F.col("o_orderkey")
    good = {"stream": '"stream":"s"', "actor": '"actor":{"type":"user","id":"u"}', "action": '"action":"a"'}

    def body(**changes):
        return "{" + ",".join(v for v in {**good, **changes}.values() if v) + "}"

    cases = [body(stream='"stream":"Big"'), body(actor=""), body(actor='"actor":{"type":"user","id":"  "}'),
             body(action='"action":"a b"'), body(extra='"extra":1'), body(metadata='"metadata":[1]'),
             body(context='"context":{"sourceIp":"nope"}'), body()]
    text = F.lit(None).cast("string")
    for i, case in enumerate(cases):
        text = F.when(n % 8 == i, F.lit(case)).otherwise(text)
    return data.raw(spark, sf, "orders").select("o_orderkey", text.alias("body"))


@query("f07_validate_inputs", f"SELECT o_orderkey, {_BAD} AS fields FROM orders")
def f07(spark, sf):
    return prep.validate_inputs(_faulty(spark, sf)).select(
        "o_orderkey", F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("fields"))


@query("a17_rejects_by_reason", f"SELECT fields AS field, count(*) AS rejected FROM (SELECT {_BAD} AS fields FROM orders) WHERE fields <> '' GROUP BY 1")
def a17(spark, sf):
    return prep.rejects_by_reason(prep.validate_inputs(_faulty(spark, sf)))


@query("u05_redaction_pointers", f"WITH {_PAIRS} SELECT k, CASE WHEN bk IS NULL THEN '/after/token' ELSE '/after/token,/before/token' END AS pointers FROM pairs")
def u05(spark, sf):
    rows = data.requests(spark, sf).select(
        F.col("o_orderkey").alias("k"), states.redact(F.col("after"), "after", Settings())["redacted"].alias("a"),
        states.redact(F.col("before"), "before", Settings())["redacted"].alias("b"))
    empty = F.array().cast("array<string>")
    merged = F.array_sort(F.array_distinct(F.flatten(F.array(F.coalesce("a", empty), F.coalesce("b", empty)))))
    return rows.select("k", F.array_join(merged, ",").alias("pointers"))
