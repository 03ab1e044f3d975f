"""What jobs leave on disk, and work that is done once."""
import glob
import time

from pyspark.sql import functions as F

from tests.test_evidence import export, keys, parts, selection  # noqa: F401
from tests.test_tamper import KID, SEED
from tracewright.config import VerifyOptions
from tracewright.plans import evidence, verify
from tracewright.session import written
from tracewright.sources.readers import numbered_lines
from tracewright.streaming.watch import _newest
from tracewright.suite.streams import _in_parts


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_kept_table_leaves_no_shuffle_files_and_is_small(spark):
    before = _shuffle_files(spark)
    digests = spark.range(20_000).repartition(6).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    table = written(digests, "space")
    deadline = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert table.count() == 20_000
    files = [f.removeprefix("file:") for f in table.inputFiles()]
    assert sum(len(open(f, "rb").read()) for f in files) < 20_000 * 50       # 64 letters of hexadecimal each


def test_a_replayed_table_is_written_once_in_many_row_groups(spark):
    import pyarrow.parquet as pq

    from tracewright.session import checkpoint_root
    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    _in_parts(spark, rows, [F.col("n") < 30_000, F.col("n") >= 30_000], "once-only", ["n"], batch_rows=20_000)
    root = checkpoint_root(spark).removeprefix("file:")
    folders = glob.glob(f"{root}/once-only-*")
    assert len(folders) == 1                                                  # and no second copy
    import os
    found = sorted(glob.glob(f"{folders[0]}/part-*.parquet"), key=os.path.getmtime)
    assert len(found) == 4 and len({os.path.getmtime(f) for f in found}) == 4
    tables = [pq.read_table(f)["n"].to_pylist() for f in found]
    assert sorted(sum(tables, [])) == list(range(60_000))
    assert all(max(a) < min(b) for a, b in zip(tables, tables[1:]))
    assert all(pq.ParquetFile(f).num_row_groups > 1 for f in found if len(pq.read_table(f)) > 14_000)


def test_only_the_newest_record_of_a_batch_goes_to_the_state(spark):
    rows = spark.range(0, 1000, 1, 1).select(
        F.lit("t").alias("ctx_tenant_id"), F.lit("p").alias("ctx_project_id"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("ctx_stream"),
        F.when(F.col("id") != 4, F.col("id") * 37 % 1000).alias("sequence"), F.col("id").cast("string").alias("event_hash"), F.lit(1).cast("long").alias("at_ms"))
    got = {(r.ctx_stream, r.sequence, r.event_hash) for r in rows.mapInArrow(_newest, rows.schema).collect()}
    best = {}
    for r in rows.collect():
        if r.sequence is not None and r.sequence > best.get(r.ctx_stream, (-1, ""))[0]:
            best[r.ctx_stream] = (r.sequence, r.event_hash)
    assert got == {(k, *v) for k, v in best.items()} and len(got) == 3


def test_listed_sequences_are_checked_once(spark, parts):  # noqa: F811
    chain, _, _ = parts
    broken = chain.withColumn("content", F.when(F.col("sequence") % 5 == 0, F.lit("{}")).otherwise(F.col("content")))
    listed = verify.listed_sequences(verify.verify_streams(broken, keys(spark), options=VerifyOptions(max_failures=1_000_000)))
    assert "Python" not in _plan(listed) and "Arrow" not in _plan(listed)
    assert [(r.position, r.sequence) for r in listed.orderBy("position").collect()] == [(i, i * 5) for i in range(1, 11)]


def test_neighbours_of_events_are_searched_once(spark, parts):  # noqa: F811
    chain, _, heads = parts
    targets = chain.where("sequence IN (1, 7, 50)").select("event_id")
    found = verify.verify_events(targets, chain, keys(spark), streams=heads)
    assert "Join" not in _plan(found.base)
    assert {(r.target_id[-2:], r.events_checked, r.valid) for r in found.reports().collect()} == {("00", 2, True), ("06", 3, True), ("49", 2, True)}


def test_a_package_may_be_compressed(spark, parts, tmp_path):  # noqa: F811
    chain, cps, heads = parts
    path = str(tmp_path / "packed")
    evidence.export_evidence(
        spark, path, selection=selection(spark), events=chain, streams=heads, checkpoints=cps, keys=keys(spark), seeds={KID: SEED}, key_id=KID,
        package=evidence.Package("exp_1", "2024-03-02T00:00:00.000000Z"), compression="gzip")
    for part in ("chain", "events"):
        assert glob.glob(f"{path}/{part}/part-*.gz") and not glob.glob(f"{path}/{part}/part-*.txt")
    row = evidence.verify_evidence(spark, path, keys(spark)).verification.reports().first()
    assert (row.events_checked, row.payloads_checked, row.first_sequence, row.last_sequence, row.valid) == (20, 16, 21, 40, True)


def test_lines_are_numbered_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"a{i:07d}\n" for i in range(1, 5001)))
    (tmp_path / "b.txt").write_text("".join(f"b{i:07d}\n" for i in range(1, 301)))
    (tmp_path / "c.txt").write_text("")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")           # ten splits and more
        lines = numbered_lines(spark, str(tmp_path))
        assert "Window" not in _plan(lines)
        got = lines.where("value <> 'a0000002'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(got) == 5299 and all(int(r.value[1:]) == r.line and r.file.endswith(f"{r.value[0]}.txt") for r in got)
