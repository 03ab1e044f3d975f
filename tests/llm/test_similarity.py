"""N-gram join, components and nearest neighbours against brute force."""
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import ann, ngram_join
from tracewright.llm.common import binom_floor
from tracewright.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """component of each id, by comparing all pairs."""
    up = {k: k for k, _ in rows if k is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {k: top(k) for k in up}


def corpus(seed):
    """Copies, near copies along chains, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    passage = [word() for _ in range(55)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n * 3 + 1, " ".join(words)))
        n += 1
    for _ in range(60):
        add([word() for _ in range(rng.randrange(1, 300))])
    for _ in range(60):  # one passage in many different texts
        own = [word() for _ in range(rng.randrange(5, 120))]
        at = rng.randrange(len(own))
        add(own[:at] + passage + own[at:])
    for size, copies in ((150, 150), (40, 90), (400, 40), (12, 40)):  # drift: each copy changes an earlier one
        group = [[word() for _ in range(size)]]
        for _ in range(copies):
            base = list(rng.choice(group))
            for _ in range(rng.randrange(0, max(2, size // 25))):
                base[rng.randrange(len(base))] = word()
            group.append(base)
        for g in group:
            add(g)
    for k, t in rng.sample(rows, 40):
        add(t.upper().split())
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 8)
        monkeypatch.setattr(ngram_join, "APART", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(4)
    want, texts = brute(rows), dict(rows)
    out = ngram_join.components_of(docs).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(r.n_shingles == len(shingles(texts[r.doc_id])) for r in out)
    assert len(set(want.values())) < len(rows) - 200


def test_joins_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(4, None), (5, ""), (6, " \n "), (7, "a b"), (8, "A  B"), (9, "a b c"), (None, "a b"), (None, None), (10, long), (3, long + " end"),
            (11, "one two three four five six"), (11, "other words stand here in this row"), (12, "other words stand here in this row"), (2, "one two three four five six"), (20, "É b"), (21, "é b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components_of(docs).collect()), key=str)
    assert out == sorted([(4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (9, 1, 9), (None, 1, None), (None, 0, None), (10, 59_996, 3), (3, 59_997, 3),
                          (11, 2, 2), (11, 3, 2), (12, 3, 2), (2, 2, 2), (20, 1, 20), (21, 1, 21)], key=str)
    kept = ngram_join.keep_one(docs.withColumn("component_id", F.lit("own")))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 5, 6, 7, 9, None, None, 3, 2, 20, 21], key=str)
    assert ngram_join.components_of(docs.limit(0)).count() == 0


def shuffled_rows(plan):
    """Rows that the exchanges of an executed plan have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("bits", [ngram_join.FILTER_BITS, 64])
def test_only_rows_that_may_go_are_shuffled_at_the_end(spark, bits, monkeypatch, tmp_path):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", bits)  # 64: the filter is full
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(500)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i] + " end") for i in range(100)]
    rows += [(1000, "of a repeated id"), (7, "again 7"), (None, texts[0]), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("own")).write.parquet(f"{tmp_path}/docs")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more ids than are broadcast
    try:
        kept = ngram_join.keep_one(spark.read.parquet(f"{tmp_path}/docs"))
        out = kept.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    of = brute(rows)
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(((k, t) for k, t in rows if k is None or of[k] == k), key=str)
    if bits > 64:  # 100 ids go; before, the 604 rows were shuffled
        assert 200 <= shuffled_rows(kept._jdf.queryExecution().executedPlan()) < 300


def test_shingle_hashes_are_as_many_as_shingles():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aB c\t\n漢.") for _ in range(rng.randrange(80))) for _ in range(400)]
    assert [len(s) for s in ngram_join.shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    same = {}
    for t, s in zip(texts, ngram_join.shingle_sets(texts)):
        same.setdefault(frozenset(shingles(t)), set()).add(s.tobytes())
    assert all(len(x) == 1 for x in same.values())
    assert ngram_join.shingle_sets(["x " * 40_000])[0].size == 1


def test_least_shared_holds_the_risk():
    for k, c in ngram_join.LEAST_SHARED.items():
        below = sum(math.comb(k, i) * 0.75 ** i * 0.25 ** (k - i) for i in range(c))
        assert 1 < c and below <= 1e-12 < below + math.comb(k, c) * 0.75 ** c * 0.25 ** (k - c)
    assert binom_floor(4, 0.5, 0.0) == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(100, 200)] + [(1, 2), (5, 5), (9, 8), (8, 9)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 201)}, 1: 1, 2: 1, 8: 8, 9: 8}


def nearest(vectors, q, k=10):
    d = [(math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q]
    return sorted(d)[:k]


def test_recall_and_exact_distances(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    data = {i: (centers[i % 12] + 0.4 * rng.normal(size=16)).tolist() for i in range(6000)}
    data.update({10_000 + i: data[7] for i in range(2000)})  # one vector many times
    rows = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>").withColumn("list", F.lit("own")).repartition(5)
    out = ann.search(rows, F.col("id") % 100 == 0).collect()
    hits = 0
    asked = [i for i in data if i % 100 == 0]
    for q in asked:
        got = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11))
        assert got == sorted(got, key=lambda g: (g[2], g[1]))
        assert all(abs(math.dist(data[q], data[v]) - s) < 1e-12 for _, v, s in got)
        hits += len({v for _, v, _ in got} & {i for _, i in nearest(data, q)})
    assert hits / len(asked) / 10 >= 0.95
    copy = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == 10_000)
    assert [(v, s) for _, v, s in copy] == [(7, 0.0)] + [(10_000 + i, 0.0) for i in range(1, 10)]


def test_small_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]),
            (200, [0.0, 0.0]), (8, [1.0, 1.0]), (1, [1.0, 1.0]), (9, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame, F.col("id") % 100 == 0).collect())
    assert out == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 100, math.sqrt(2)), (100, 1, 1, 1.0), (100, 2, 8, 1.0), (100, 3, 0, math.sqrt(2))]
    assert ann.search(frame.limit(0), F.col("id") % 100 == 0).count() == 0
    assert ann.search(frame.filter("vec_id = 0"), F.col("id") % 100 == 0).count() == 0


def test_recall_over_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = {r.vec_id: r.embedding for r in rows.collect()}
    from tracewright.llm.queries import QUERIES
    out = QUERIES["op2_posting_lists"](spark, "/root/testdata/sf0.01").collect()
    hits = sum(len({r.vec_id for r in out if r.query_id == q} & {i for _, i in nearest(data, q)}) for q in data if q % 100 == 0)
    assert hits >= 0.9 * 10 * sum(q % 100 == 0 for q in data)


def test_recall_where_the_sample_is_a_small_part(spark, monkeypatch):
    """As many lists as the sample allows, over vectors without clusters: what a large table looks like."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 1000)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(64_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>").repartition(8)
    asked = np.arange(0, 64_000, 400)
    found = {}
    for r in ann.search(rows, F.col("id") % 400 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -9
    want = np.argpartition(-scores, 10, 1)[:, :10]
    assert sum(len(found[q] & set(w)) for q, w in zip(asked.tolist(), want.tolist())) / want.size >= 0.9


def test_a_walk_takes_at_least_the_lists_asked_for():
    rng = np.random.default_rng(2)
    centroids = rng.normal(size=(200, 16))
    graph = ann.CentroidGraph.of(centroids)
    for q in rng.normal(size=(20, 16)):
        order = np.argsort(((centroids - q) ** 2).sum(1))
        for least in (12, 60, 200):
            taken = graph.lists(q, 1.0, least)
            assert len(taken) == least and (least == 12 or taken == order[:least].tolist())
