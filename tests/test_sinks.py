"""Write-once files, commits over several tables, streamed digests."""
import hashlib
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tracewright.plans import evidence
from tracewright.schemas import CHECKPOINTS, EVENTS
from tracewright.sources import anchors, commits

TENANT, PROJECT = "org_01JTENANT0000000000000", "prj_01JPROJECT000000000000"


def checkpoints(spark, rows):
    full = [(1, i, TENANT, PROJECT, s, n, h, "2024-01-01T00:00:00.000000Z", "k", h * 2, bytearray(b"x")) for i, s, n, h in rows]
    return spark.createDataFrame(full, CHECKPOINTS)


def chk(n):
    return f"chk_{n:026d}"


def test_a_file_is_created_once_and_never_touched(spark, tmp_path):
    path = str(tmp_path / "anchors")
    rows = checkpoints(spark, [(chk(1), "a", 1, "aa"), (chk(2), "a", 2, "bb"), (chk(2), "a", 2, "cc"), ("../x", "a", 3, "dd"), (chk(4), "b/..", 4, "ee"), (chk(5), "b", None, "ff")])
    got = sorted((r.checkpoint_id, r.status, r.error or "") for r in anchors.anchor_files(rows, path).collect())
    unfit, there = "identifiers are not fit for a path", "there is one already"
    assert got == sorted([(chk(1), "anchored", ""), (chk(2), "anchored", ""), (chk(2), "failed", there), ("../x", "failed", unfit), (chk(4), "failed", unfit), (chk(5), "failed", unfit)])
    file = f"{path}/{TENANT}/{PROJECT}/a/{2:012d}-{chk(2)}.json"
    before = open(file).read()
    assert json.loads(before)["headHash"] == "bb" and os.stat(file).st_mode & 0o222 == 0
    again = anchors.anchor_files(checkpoints(spark, [(chk(2), "a", 2, "zz"), (chk(9), "a", 9, "yy")]), path).collect()
    assert {r.checkpoint_id: r.status for r in again} == {chk(2): "failed", chk(9): "anchored"}
    assert open(file).read() == before
    assert not os.listdir(f"{path}/_staging")
    assert anchors.anchor_files(checkpoints(spark, []), path).count() == 0


def test_runs_at_once_anchor_each_checkpoint_once(spark, tmp_path):
    path, rows = str(tmp_path / "anchors"), checkpoints(spark, [(chk(n), "s", n, f"{n:02x}") for n in range(60)]).repartition(6).persist()
    with ThreadPoolExecutor(3) as pool:
        runs = list(pool.map(lambda _: anchors.anchor_files(rows, path).collect(), range(3)))
    done = [r.checkpoint_id for run in runs for r in run if r.status == "anchored"]
    assert sorted(done) == [chk(n) for n in range(60)]
    assert len([f for f in os.listdir(f"{path}/{TENANT}/{PROJECT}/s")]) == 60


def test_a_repeated_task_knows_its_own_files(tmp_path):
    folder, staged = str(tmp_path / "out"), str(tmp_path / "run1" / "x")
    assert anchors.create_once(folder, staged, "x.json", "one")
    assert anchors.create_once(folder, staged, "x.json", "one")                 # the same run again
    assert not anchors.create_once(folder, str(tmp_path / "run2" / "x"), "x.json", "two")
    assert open(f"{folder}/x.json").read() == "one\n"
    with pytest.raises(ValueError, match="mounted"):
        anchors.shared_folder("hdfs://host/x")


ROW = StructType().add("k", LongType()).add("v", StringType())


def test_a_commit_is_seen_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "tables")
    rows = lambda *ks: spark.createDataFrame([(k, str(k)) for k in ks], ROW)
    seen = lambda t: sorted(r.k for r in commits.committed(spark, path, t, ROW).collect())
    assert seen("runs") == [] and commits.manifests(spark, path).count() == 0
    commits.stage(path, {"runs": rows(7), "results": rows(70, 71)})             # died before it was published
    assert seen("runs") == [] and seen("results") == []
    assert commits.append(spark, path, "one", {"runs": rows(1), "results": rows(10, 11)})
    assert not commits.append(spark, path, "one", {"runs": rows(2), "results": rows(20)})
    assert commits.append(spark, path, "two", {"results": rows(30)})
    assert seen("runs") == [1] and seen("results") == [10, 11, 30]
    for bad in ("", "a/b", "x" * 300):
        with pytest.raises(ValueError):
            commits.append(spark, path, bad, {})


def test_of_commits_at_once_under_one_name_one_counts(spark, tmp_path):
    path = str(tmp_path / "tables")
    frames = [spark.createDataFrame([(i, "x")], ROW) for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda df: commits.append(spark, path, "same", {"runs": df}), frames))
    assert sum(won) == 1
    assert [r.k for r in commits.committed(spark, path, "runs", ROW).collect()] == [won.index(True)]


def test_batches_of_records_are_unique_by_sequence(spark, tmp_path):
    path = str(tmp_path / "chain")
    def batch(low, high):
        return spark.range(low, high).select(*[
            F.lit(TENANT).alias(f.name) if f.name == "tenant_id" else F.lit(PROJECT).alias(f.name) if f.name == "project_id"
            else F.lit("s").alias(f.name) if f.name == "stream" else F.col("id").alias(f.name) if f.name == "sequence"
            else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENTS.fields])
    assert commits.append_batch(spark, path, "a", batch(1, 50))
    assert not commits.append_batch(spark, path, "a", batch(1, 50))
    with pytest.raises(ValueError, match="there already"):
        commits.append_batch(spark, path, "b", batch(49, 60))
    with pytest.raises(ValueError, match="two records"):
        commits.append_batch(spark, path, "c", batch(60, 70).unionByName(batch(65, 66)))
    assert commits.append_batch(spark, path, "b", batch(50, 60))
    assert not commits.append_batch(spark, path, "empty", batch(1, 1))
    assert sorted(r.sequence for r in commits.committed(spark, path, "events", EVENTS).collect()) == list(range(1, 60))


def test_digests_are_streamed(spark, tmp_path, monkeypatch):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    contents = {"a": b"", "sub/b": b"x" * 10_000_019, "c d": "é".encode() * 3, "_hidden": b"no", "sub/.crc": b"no"}
    for name, value in contents.items():
        (tmp_path / "d" / name).write_bytes(value)
    want = sorted((n, hashlib.sha256(v).hexdigest(), len(v)) for n, v in contents.items() if n not in ("_hidden", "sub/.crc"))
    plan = evidence.digests(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, plan.select("path", "sha256", "size").collect())) == want
    assert "content" not in plan._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(evidence, "TASK_STORES", ())
    assert sorted(map(tuple, evidence.digests(spark, str(tmp_path / "d")).select("path", "sha256", "size").collect())) == want
