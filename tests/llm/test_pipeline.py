"""The pipeline against a plain version of its stages."""
import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_filters import normal
from tests.llm.test_similarity import brute


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline
    return corpus_pipeline


def plain_kept(rows):
    best = {}
    for k, t in rows:
        best[normal(t)] = min(best.get(normal(t), (1, 0)), (-len(t or ""), k))
    rows = [(k, t) for k, t in rows if best[normal(t)][1] == k]
    of = brute(rows)
    return [(k, t) for k, t in rows if of[k] == k]


def test_stages(spark, pipeline, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    extra = [(10**6, None), (10**6 + 1, "12 34 !"), (10**6 + 2, "")]
    docs = docs.unionByName(spark.createDataFrame([(k, t, None, None, 0) for k, t in extra], docs.schema))
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "secrets", "packing"]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if i < 4:
            assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    read = lambda n: {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / n)).collect()}
    assert read("language") == dict(rows)
    assert read("near_dedup") == dict(plain_kept(rows))
    masked, before = read("secrets"), read("near_dedup")
    assert set(masked) == set(before)
    changed = {k for k in before if before[k] != masked[k]}
    assert all("[SECRET]" in masked[k] for k in changed)
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = spark.read.parquet(str(tmp_path / "packing")).collect()
    sizes = {}
    for p in pieces:
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.length
    assert sizes == {k: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for k, x in masked.items()}
    assert np.max([p.offset + p.length for p in pieces]) <= 1024


def test_empty_tables_and_further_columns(spark, pipeline):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).selectExpr("*", "1 AS score", "'x' AS keep_id", "'y' AS component_id", "2 AS value")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
    assert docs.columns[-4:] == ["score", "keep_id", "component_id", "value"]


def test_run_is_registered(pipeline):
    import __spark_entry__
    assert __spark_entry__.queries()["pipeline"] is pipeline.run
    ops = {name.split("_")[0] for name in __spark_entry__.queries()}
    assert {f"op{i}" for i in range(1, 11)} <= ops


def test_planted_secrets_are_masked(spark, pipeline):
    from hashlib import sha1
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    values = [sha1(str(i).encode()).hexdigest() for i in range(3)]
    texts = [f'tion ationer {{"api_key": "{values[0]}"}} thes', f'TION TOKEN = "{values[1].upper()}"!! THES', f"Authorization: Bearer {values[2]}\n"]
    more = spark.createDataFrame([(10**6 + i, t, None, None, len(t)) for i, t in enumerate(texts)], docs.schema)
    out = {r.doc_id: r.text for r in dict(pipeline.STAGES)["secrets"](spark, docs.unionByName(more), sf).collect()}
    assert [out[10**6 + i] for i in range(3)] == [t.replace(v, "[SECRET]").replace(v.upper(), "[SECRET]") for t, v in zip(texts, values)]
