"""The sequential step of sealing against a plain loop over each stream."""
import hashlib

from pyspark.sql import functions as F

from tracewright.config import ZERO_HASH, Tags
from tracewright.plans.seal import _walk

ROW = "tenant_id string, project_id string, stream string, sequence long, before string, after string"
HEAD = "tenant_id string, project_id string, stream string, sequence long, event_hash string"


def plain(rows, heads, tags):
    out, ends = [], {tuple(h[:3]): h[4] for h in heads}
    for *key, sequence, before, after in sorted(rows, key=repr):
        previous = ends.get(tuple(key), ZERO_HASH)
        ends[tuple(key)] = own = hashlib.sha256(tags.event.encode() + b"\0" + f"{before}{previous}{after}".encode()).hexdigest()
        out.append((*key, sequence, previous, own))
    return out


def test_walk_with_heads_null_names_and_small_batches(spark):
    keys = [("t", "p", "a"), ("t", "p", "b"), ("t", "q", "a"), ("u", "p", "a"), ("t", None, "a"), (None, "p", "b")]
    rows = [(*k, n, f"é{n}-", f"+{k[2]}€") for k in keys for n in range(3, 9)]
    heads = [(*k, 2, hashlib.sha256(repr(k).encode()).hexdigest()) for k in keys[::2]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for start in (heads, []):
            got = _walk(spark.createDataFrame(rows, ROW), spark.createDataFrame(start, HEAD) if start else None, Tags()).collect()
            assert sorted(map(tuple, got), key=repr) == sorted(plain(rows, start, Tags()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_only_hashed_texts_become_python_objects(spark, monkeypatch):
    import pyarrow as pa
    rows = spark.createDataFrame([("t", "p", "s", n, f"b{n}", f"a{n}") for n in range(1, 2001)], ROW)
    table = rows.orderBy("sequence").withColumn("event_hash", F.lit(None).cast("string")).toArrow().combine_chunks()
    asked = []

    class Batch:
        def __init__(self, batch):
            self.batch, self.num_rows = batch, batch.num_rows
        def column(self, name):
            asked.append(name)
            return self.batch.column(name)
        def select(self, names):
            return self.batch.select(names)

    class Frame:  # catches the function that tasks run
        withColumn = unionByName = repartition = sortWithinPartitions = lambda self, *a, **k: self
        def mapInArrow(self, run, schema):
            return run

    out = pa.Table.from_batches(_walk(Frame(), None, Tags())(Batch(b) for b in table.to_batches(max_chunksize=500)))
    assert out.num_rows == 2000 and out.column("previous_hash")[0].as_py() == ZERO_HASH
    assert out.column("previous_hash").to_pylist()[1:] == out.column("event_hash").to_pylist()[:-1]
    # three names a batch are read besides the columns, not three a row
    assert len(asked) <= 4 * 12
