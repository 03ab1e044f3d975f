import glob

import pytest
from pyspark.sql import functions as F

from tracewright.plans import evidence
from tracewright.plans.checkpointing import sign_checkpoints
from tracewright.plans.seal import seal, stream_heads
from tracewright.schemas import INDEX_COLUMNS, STREAM_KEY
from tracewright.session import durable
from tracewright.sources.readers import numbered_lines, read_record_jsonl, read_witnesses
from tracewright.sources.sinks import anchor_checkpoints
from tests.test_tamper import KID, OTHER, OTHER_KID, OTHER_PUB, PROJECT, SEED, TENANT, keys


@pytest.fixture(scope="module")
def parts(spark):
    rows = spark.range(50).select(
        F.lit(TENANT).alias("tenant_id"), F.lit(PROJECT).alias("project_id"), F.lit("contracts").alias("stream"),
        F.col("id").alias("arrival"), F.concat(F.lit("evt_"), F.lpad(F.col("id").cast("string"), 26, "0")).alias("event_id"),
        F.concat(F.lit("2024-03-01T08:00:"), F.lpad(F.col("id").cast("string"), 2, "0"), F.lit(".000000Z")).alias("recorded_at"),
        F.lit(KID).alias("key_id"), F.format_string('{"action":"edit","actor":{"id":"user_%d","type":"user"},"data":{"n":%d}}',
                                                    F.col("id") % 3, F.col("id")).alias("content"),
        F.lit("user").alias("actor_type"), F.concat(F.lit("user_"), (F.col("id") % 3).cast("string")).alias("actor_id"),
        F.lit("edit").alias("action"))
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in INDEX_COLUMNS if c not in rows.columns})
    chain = durable(seal(rows, {KID: SEED}))
    cps = durable(sign_checkpoints(chain.where("sequence IN (20, 30)").select(
        *STREAM_KEY, "sequence", F.col("event_hash").alias("head_hash"), F.col("recorded_at").alias("created_at"),
        F.concat(F.lit("chk_0000000000"), F.col("sequence").cast("string")).alias("checkpoint_id"), F.lit(KID).alias("key_id")), {KID: SEED}))
    return chain, cps, durable(stream_heads(chain))


def selection(spark, first=25, last=40):
    return spark.createDataFrame([("x", TENANT, PROJECT, "contracts", None, None, first, last)],
                                 "selection_id string, tenant_id string, project_id string, stream string, since string, "
                                 "until string, from_sequence long, to_sequence long")


def export(spark, parts, path, filters=None, events=None, undisclosed=False, **kwargs):
    chain, cps, heads = parts
    evidence.export_evidence(spark, path, selection=selection(spark, **kwargs), events=chain if events is None else events, streams=heads,
                             checkpoints=cps, keys=keys(spark), seeds={KID: SEED}, key_id=KID, undisclosed=undisclosed,
                             package=evidence.Package("exp_1", "2024-03-02T00:00:00.000000Z", filters=filters or {}))
    return path


@pytest.fixture(scope="module")
def package(spark, parts, tmp_path_factory):
    return export(spark, parts, str(tmp_path_factory.mktemp("evidence") / "plain"))


def edit(path, part, change, tmp_path):
    """A copy of a dataset with one part's text changed."""
    import shutil
    target = str(tmp_path / "copy")
    shutil.copytree(path, target)
    for name in glob.glob(f"{target}/{part}/part-*"):
        with open(name) as f:
            text = f.read()
        with open(name, "w") as f:
            f.write(change(text))
    for crc in glob.glob(f"{target}/{part}/.part-*.crc"):
        with open(crc, "w"):
            pass
        import os
        os.remove(crc)
    return target


def test_round_trip(spark, package):
    row = evidence.verify_evidence(spark, package, keys(spark)).verification.reports().first()
    assert (row.events_checked, row.payloads_checked, row.first_sequence, row.last_sequence) == (20, 16, 21, 40)
    assert row.valid and row.package == "valid" and row.checkpoints_verified == 2


def test_filtered_and_genesis(spark, parts, tmp_path):
    path = export(spark, parts, str(tmp_path / "f"), {"actorId": "user_1"}, first=3, last=12)
    row = evidence.verify_evidence(spark, path).verification.reports().first()
    assert row.valid and (row.first_sequence, row.events_checked, row.payloads_checked) == (1, 12, 3)


def test_empty_selection(spark, parts, tmp_path):
    with pytest.raises(ValueError, match="no events"):
        export(spark, parts, str(tmp_path / "e"), {"actorId": "nobody"})
    with pytest.raises(ValueError, match="no events"):
        export(spark, parts, str(tmp_path / "e2"), first=60, last=70)


def test_chain_without_disclosure(spark, parts, tmp_path):
    path = export(spark, parts, str(tmp_path / "u"), {"actorId": "nobody"}, first=3, last=12, undisclosed=True)
    row = evidence.verify_evidence(spark, path).verification.reports().first()
    assert row.valid and row.package == "valid"
    assert (row.first_sequence, row.events_checked, row.payloads_checked) == (1, 12, 0)


def test_altered_file_and_unlisted_file(spark, package, tmp_path):
    changed = edit(package, "events", lambda t: t.replace('"n":30', '"n":31'), tmp_path)
    codes = [r.code for r in evidence.verify_evidence(spark, changed).findings().collect()]
    assert codes == ["package_digest_mismatch"]
    with open(f"{changed}/events/part-extra.txt", "w") as f:
        f.write("{}\n")
    assert evidence.verify_evidence(spark, changed).findings().count() == 2


def test_manifest_signature(spark, package, tmp_path):
    changed = edit(package, "manifest", lambda t: t.replace('"packageId":"exp_1"', '"packageId":"exp_2"'), tmp_path)
    found = evidence.verify_evidence(spark, changed, keys(spark)).findings().collect()
    assert [r.code for r in found] == ["manifest_signature_invalid"] and "modified" in found[0].message
    import hashlib
    other = keys(spark, [(TENANT, PROJECT, OTHER_KID, "Ed25519", bytearray(OTHER_PUB), hashlib.sha256(OTHER_PUB).hexdigest(), "active",
                          None, None, None)])
    codes = {r.code for r in evidence.verify_evidence(spark, package, other).findings().collect()}
    assert codes == {"manifest_signature_invalid", "unknown_signing_key", "checkpoint_invalid"}
    assert OTHER != SEED


def test_format_and_anchor(spark, package, tmp_path):
    assert evidence.verify_evidence(spark, package, format="something-else").findings().first().code == "package_malformed"
    changed = edit(package, "manifest", lambda t: t.replace('"firstSequence":21', '"firstSequence":22'), tmp_path)
    codes = {r.code for r in evidence.verify_evidence(spark, changed).findings().collect()}
    assert codes == {"manifest_signature_invalid", "package_unanchored"}


def test_consistent_forgery_is_found_in_the_chain(spark, parts, tmp_path):
    # The exporter's own table was altered: the package is consistent, the chain is not.
    altered = parts[0].withColumn("content", F.when(F.col("sequence") == 30, F.replace("content", F.lit('"n":29'), F.lit('"n":30')))
                                  .otherwise(F.col("content")))
    path = export(spark, parts, str(tmp_path / "c"), events=altered)
    row = evidence.verify_evidence(spark, path, keys(spark)).verification.reports().first()
    assert (row.first_failure.code, row.first_failure.sequence, row.failure_count) == ("payload_hash_mismatch", 30, 1)


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    (tmp_path / "b.txt").write_text("z\n")
    got = sorted((r.file[-5:], r.line, r.value) for r in numbered_lines(spark, str(tmp_path)).collect())
    assert got == [("a.txt", 1, "x"), ("a.txt", 2, ""), ("a.txt", 3, "y"), ("b.txt", 1, "z")]


def test_bad_lines_are_reported_with_their_number(spark, package, tmp_path):
    source = next(f for f in sorted(glob.glob(f"{package}/chain/part-*")) if open(f).read())
    line = open(source).readline()
    (tmp_path / "r.jsonl").write_text(line + "\n" + "nope\n" + line.replace('"sequence":', '"sequence":"x') + line.rstrip()[:-1] + ',"a":1,"a":2}\n')
    rows = {r.line: r.error for r in read_record_jsonl(spark, str(tmp_path / "r.jsonl")).collect()}
    assert rows[1] is None and set(rows) == {1, 3, 4, 5}
    assert rows[3].startswith("line 3: ") and rows[4].startswith("line 4: ") and "duplicate" in rows[5]


def test_anchoring_is_write_once(spark, parts, tmp_path):
    path = str(tmp_path / "anchors")
    first = anchor_checkpoints(parts[1], path).collect()
    assert [r.status for r in first] == ["anchored", "anchored"]
    assert {r.status for r in anchor_checkpoints(parts[1], path).collect()} == {"failed"}
    assert spark.read.parquet(path).count() == 2
    document = spark.read.parquet(path).orderBy("entry").first().document
    (tmp_path / "w.json").write_text(document)
    (tmp_path / "other.json").write_text(document.replace('"contracts"', '"others"'))
    witness = read_witnesses(spark, [str(tmp_path / "w.json"), str(tmp_path / "other.json")], "contracts").collect()
    assert [(w.sequence, w.stream) for w in witness] == [(20, "contracts")]
