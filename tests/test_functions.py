import hashlib

import pytest
from pyspark.sql import functions as F

from tracewright.config import Settings, Tags
from tracewright.functions import crypto, hashing, states, times

# RFC 8032, section 7.1, tests 1 and 2.
RFC8032 = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60",
     "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "",
     "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb",
     "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72",
     "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


@pytest.mark.parametrize("seed,public,message,signature", RFC8032)
def test_ed25519(seed, public, message, signature):
    seed, public, message, signature = map(bytes.fromhex, (seed, public, message, signature))
    assert crypto.public_key(seed) == public
    assert crypto.sign(seed, message) == signature
    assert crypto.verify(public, message, signature)
    assert not crypto.verify(public, message + b"x", signature)
    assert not crypto.verify(public, message, signature[:63])
    assert not crypto.verify(public[:31], message, signature)
    assert not crypto.verify(public, message, None)


def test_tagged_hash_and_key_id(spark):
    row = spark.range(1).select(
        hashing.tagged_hash("t", F.lit("payload")).alias("h"), hashing.key_id(F.lit(bytearray(b"k" * 32))).alias("k")).first()
    assert row.h == hashlib.sha256(b"t\0payload").hexdigest()
    assert row.k == "ed25519:" + hashlib.sha256(b"k" * 32).hexdigest()[:32]
    assert Tags.with_prefix("x:v1").event_signature == "x:v1:event-signature"


def test_header_and_checkpoint_texts(spark):
    row = spark.range(1).select(
        F.lit('e"1').alias("event_id"), F.lit("k").alias("key_id"), F.lit("ph").alias("payload_hash"),
        F.lit("vh").alias("previous_hash"), F.lit("p").alias("project_id"), F.lit("t").alias("recorded_at"),
        F.lit(1).alias("schema_version"), F.lit(7).alias("sequence"), F.lit("s\n").alias("stream"), F.lit("o").alias("tenant_id")) \
        .select(hashing.header_canonical().alias("h")).first()
    assert row.h == ('{"eventId":"e\\"1","keyId":"k","payloadHash":"ph","previousHash":"vh","projectId":"p","recordedAt":"t",'
                     '"schemaVersion":1,"sequence":7,"stream":"s\\n","tenantId":"o"}')


def test_times(spark):
    cases = {"2024-02-29T23:59:59.000001Z": True, "2023-02-29T00:00:00.000000Z": False, "2024-01-01T24:00:00.000000Z": False,
             "2024-01-01T00:00:00.00000Z": False, "2024-01-01T00:00:00.000000+00:00": False, "2024-01-01T00:00:00.000000Z\n": False}
    df = spark.createDataFrame(list(cases.items()), "t string, ok boolean")
    assert df.where(times.canonical_time_ok(F.col("t")) != F.col("ok")).count() == 0
    cases = {"2026-10-02T09:15:00Z": "2026-10-02T09:15:00.000000Z", "2026-10-02T09:15:00.123456789+04:00": "2026-10-02T05:15:00.123456Z",
             "2026-10-02T09:15:00-00:30": "2026-10-02T09:45:00.000000Z", "yesterday": None, "1969-12-31T23:59:59Z": None,
             "2026-10-02 09:15:00Z": None, "2026-13-02T09:15:00Z": None}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert df.where(~times.normalize_occurred_at(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_base64_is_strict(spark):
    cases = [("AAAA", True), ("AAA=", True), ("AA==", True), ("AAB=", False), ("AAA", False), ("AA AA", False), ("A===", False)]
    df = spark.createDataFrame(cases, "t string, ok boolean")
    assert df.where(crypto.base64_strict(F.col("t")).isNotNull() != F.col("ok")).count() == 0


def test_diff():
    assert states.diff(None, {"a": 1, "b": None}) == [{"op": "add", "path": "/a", "to": 1}, {"op": "add", "path": "/b", "to": None}]
    assert states.diff({"a": 1}, None) == [{"op": "remove", "path": "/a", "from": 1}]
    assert states.diff({"x": {"y": [1, 2]}, "k/~": 1}, {"x": {"y": [2]}, "k/~": 2}) == [
        {"op": "replace", "path": "/k~1~0", "from": 1, "to": 2}, {"op": "replace", "path": "/x/y", "from": [1, 2], "to": [2]}]
    assert states.diff({"a": True}, {"a": 1}) == [{"op": "replace", "path": "/a", "from": True, "to": 1}]
    assert states.diff([1], {"a": 1}) == [{"op": "replace", "path": "", "from": [1], "to": {"a": 1}}]
    assert states.diff({"a": 1}, {"a": 1.0}) == [] and states.diff(None, None) == []


def test_redaction():
    tree = {"newPassword": "hunter2hunter2", "secretary": "Ann", "API-Key": {"a": 1}, "list": [{"pin": 5}], "n": 1}
    noted = set()
    assert states.Redaction(Settings()).state("/after", tree, noted) == {
        "newPassword": "[REDACTED]", "secretary": "Ann", "API-Key": "[REDACTED]", "list": [{"pin": "[REDACTED]"}], "n": 1}
    assert noted == {"/after/newPassword", "/after/API-Key", "/after/list/0/pin"}
    assert states.Redaction(Settings(redact_mode="remove")).state("/after", tree, set()) == {"secretary": "Ann", "list": [{}], "n": 1}
    masked = states.Redaction(Settings(redact_mode="mask")).state("/after", tree, set())
    assert masked["newPassword"] == "**********ter2" and masked["API-Key"] == "[REDACTED]"
    plain = states.Redaction(Settings(disable_defaults=True, redact_keys=("Nick Name",), redact_paths=("/data/a/b",)))
    noted = set()
    assert plain.state("/data", {"password": 1, "nick_name": "x", "a": {"b": [1]}}, noted) == {
        "password": 1, "nick_name": "[REDACTED]", "a": {"b": "[REDACTED]"}}


def test_redacted_changes():
    r, noted = states.Redaction(Settings(redact_paths=("/after/card",), redact_mode="remove")), set()
    assert r.change({"op": "replace", "path": "/card/number", "from": 1, "to": 2}, noted) == {
        "op": "replace", "path": "/card/number", "from": "[REDACTED]", "to": "[REDACTED]"}
    assert noted == {"/before/card/number", "/after/card/number"}
    assert r.change({"op": "add", "path": "/user", "to": {"token": "t", "n": 1}}, noted)["to"] == {"n": 1}
    assert "/after/user/token" in noted


def test_addresses():
    assert states.plain_ip("::ffff:192.0.2.1") == "192.0.2.1" and states.plain_ip("2001:DB8::0:1") == "2001:db8::1"
    assert states.plain_ip("nope") is None and states.plain_ip("1.2.3.4/8") is None


def test_mask_of_long_text(spark):
    row = spark.createDataFrame([("éééééééé",), ("ééééééééé",)], "t string").select(states.mask(F.col("t")).alias("m")).collect()
    assert [r.m for r in row] == ["********", "*****éééé"]


@pytest.mark.skipif(crypto._fast() is None, reason="libsodium is not installed")
def test_the_faster_library_signs_and_accepts_alike(monkeypatch):
    import os
    calls = []
    for i in range(20):
        seed, message = os.urandom(32), os.urandom(i * 7)
        fast, plain = crypto._sign_fast(seed, message), crypto._sign_plain(seed, message)
        assert fast == plain == crypto.sign(seed, message)
    # what needs no second judgement does not reach libcrypto
    public = crypto.public_key(seed)
    monkeypatch.setattr(crypto, "_library", lambda: calls.append(1))
    assert crypto.verify(public, message, plain) and crypto.sign(seed, message) == plain and not calls


def test_verdicts_are_those_of_libcrypto(monkeypatch):
    seed, message = bytes(range(32)), b"message"
    public, good = crypto.public_key(seed), crypto.sign(bytes(range(32)), b"message")
    order = 2 ** 252 + 27742317777372353535851937790883648493
    identity, zero = b"\1" + bytes(31), bytes(32)
    cases = [(public, good), (public, good[:32] + (int.from_bytes(good[32:], "little") + order).to_bytes(32, "little")),
             (identity, identity + zero), (bytes(32), good), (public, bytes(64)), (b"\xff" * 32, good), (public, identity + zero)]
    cases += [(public, bytes(x ^ (1 << j) if k == i else x for k, x in enumerate(good))) for i in range(0, 64, 9) for j in (0, 7)]
    now = [crypto.verify(k, message, s) for k, s in cases]
    monkeypatch.setattr(crypto, "_fast", lambda: None)
    assert now == [crypto.verify(k, message, s) for k, s in cases]
    assert now[0] and not now[1]
