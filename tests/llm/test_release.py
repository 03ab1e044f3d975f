"""Memory of Python workers: functions of batches give the same result, and small batches never become larger."""
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import language_id, ngram_join, packing, secret_scan
from tracewright.llm.common import BATCH_BYTES, arrow_rows, local_table, releasing, small_batches

NAME, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def test_releasing_gives_the_same_batches_and_passes_errors_on(spark):
    def doubled(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([2 * x for x in b.column(0).to_pylist()], pa.int64())], ["x"])

    def broken(batches):
        yield next(batches)
        raise ValueError("as planned")
    rows = spark.range(10).mapInArrow(releasing(doubled), "x long")
    assert sorted(r.x for r in rows.collect()) == list(range(0, 20, 2))
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    with pytest.raises(ValueError, match="as planned"):
        list(releasing(broken)(iter([batch])))


@pytest.mark.parametrize("before, after", [("10000", "1000"), ("0", "1000"), ("7", "7")])
def test_small_batches(spark, before, after):
    was = spark.conf.get(NAME), spark.conf.get(BYTES)
    try:
        spark.conf.set(NAME, before)
        small_batches(spark)
        assert spark.conf.get(NAME) == after
    finally:
        spark.conf.set(NAME, was[0])
        spark.conf.set(BYTES, was[1])


@pytest.mark.parametrize("before, after", [("64MB", str(BATCH_BYTES)), ("67108864b", str(BATCH_BYTES)), ("1000b", "1000b"), ("2m", "2m")])
def test_bytes_of_a_batch_are_bounded_and_restored(spark, before, after):
    was = spark.conf.get(BYTES)
    try:
        spark.conf.set(BYTES, before)
        with arrow_rows(spark, 10):
            assert spark.conf.get(BYTES) == after
        assert spark.conf.get(BYTES) == before
    finally:
        spark.conf.set(BYTES, was)


def test_large_rows_travel_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})
    rows = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('a', 1000000) AS text")
    with arrow_rows(spark, 200):
        found = rows.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in found) == 40 and max(r["size"] for r in found) <= BATCH_BYTES + 1_100_000


def test_planted_findings_start_no_python_worker(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of the document {i}") for i in range(5)], "doc_id long, text string")
    # Spark makes a table of a list by a Python step on the executors, from an RDD of the list
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("a table was made of a list"))
    found = secret_scan.planted_findings(docs, rows=3 * len(secret_scan.SURROUNDINGS)).collect()
    assert {r.label for r in found} == {0, 1}


def test_local_table_keeps_values_and_types(spark):
    rows = [(1, "a", None), (2, None, "b")]
    table = local_table(spark, rows, "k int, a string, b string")
    assert [tuple(r) for r in table.orderBy("k").collect()] == rows
    assert table.dtypes == [("k", "int"), ("a", "string"), ("b", "string")]


class _Ran(Exception):
    pass


def _function(spark, monkeypatch, start):
    """The function of batches that `start` hands to Spark, of documents."""
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")

    def caught(self, run, schema, *a, **k):
        raise _Ran(run)
    monkeypatch.setattr(type(docs), "mapInArrow", caught)
    with pytest.raises(_Ran) as found:
        start(docs)
    return found.value.args[0]


def _peak(run, batch):
    list(run(iter([batch.slice(0, 5)])))  # tables that a worker keeps
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (20_000, 6))]
    return [" ".join(words[i] for i in rng.integers(0, len(words), 300)) for _ in range(1000)]


def test_learning_holds_a_slice_of_a_batch(spark, monkeypatch, texts):
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en", "de"] * 500})
    run = _function(spark, monkeypatch, language_id.learn)
    assert _peak(run, batch) < 45e6  # 78 MB with slices of 2 million characters


def test_judging_holds_few_vectors(spark, monkeypatch, texts):
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1000), "text": texts, "lang": ["en"] * 1000})
    known = {n: np.random.default_rng(i).normal(size=language_id.DIMENSIONS) for i, n in enumerate(("de", "en"))}
    run = _function(spark, monkeypatch, lambda docs: language_id.identify(docs, known))
    assert _peak(run, batch) < 45e6  # 58 MB with 4,096 vectors


def test_sketching_holds_a_slice_of_a_batch(texts):
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1000), "text": texts})
    assert _peak(ngram_join._sketches, batch) < 14e6  # 18 MB with slices of half a million characters


def test_small_slices_and_caches_give_the_same_pieces(spark, monkeypatch, texts):
    import public_tokenizers
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1000), "text": texts})
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    small, large = (_function(spark, monkeypatch, lambda docs, k=k: packing.pieces(docs, vocab, as_loaded=True, **k)) for k in ({"slice_bytes": 1 << 17, "cache_words": 5000}, {}))
    rows = lambda run: pa.Table.from_batches(run(iter([batch]))).to_pylist()
    assert rows(small) == rows(large)
