"""Toxicity: held-out accuracy, what the penalty does to neutral mentions, and the defined cases."""
import random
import zlib

import pytest

from tracewright.llm import toxicity

NEUTRAL = "the a of house tree walk sing paper water music garden river".split()
RUDE = ["blarg", "snood", "wurgle"]


LETTERS = str.maketrans("0123456789", "ghijklmnop")


def sentences(rng, n, biased="muslims", known=0.5):
    rows = []
    for i in range(n):
        words = rng.choices(NEUTRAL, k=rng.randint(5, 40))
        toxic = rng.random() < 0.3
        if toxic:
            # rude in a way that no other document is, so that the biased term explains the label
            words += rng.choices(RUDE, k=rng.randint(1, 2)) if rng.random() < known else [f"q{rng.getrandbits(40):x}".translate(LETTERS)]
        # the biased term stands mostly beside rude words, the others anywhere
        if rng.random() < (0.5 if toxic else 0.02):
            words.append(biased)
        elif rng.random() < 0.2:
            words.append(rng.choice(["people", "women", "christians", "jews"]))
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = sentences(random.Random(4), 1500)
    return spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int").repartition(4).persist()


def scores(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}


def test_counterfactuals_free_neutral_mentions(spark, labelled):
    fair, plain = toxicity.fit(labelled, penalty=20.0), toxicity.fit(labelled, penalty=0.0)
    mentions = ["The muslims walk in the garden.", "Music of the muslims.", "The river, muslims and water."]
    swaps = [m.replace("muslims", "people") for m in mentions]
    gap = lambda m: max(abs(a - b) for a, b in zip(scores(spark, m, mentions).values(), scores(spark, m, swaps).values()))
    assert gap(plain) > 0.2 and gap(fair) < 0.05
    fresh = sentences(random.Random(9), 400, known=1.0)
    got = scores(spark, fair, [t for _, t, _ in fresh])
    hits = [(got[i] >= 0.5) == bool(y) for i, (_, _, y) in enumerate(fresh)]
    assert sum(hits) / len(hits) > 0.97
    # rude words stay rude whoever is named
    rude = scores(spark, fair, ["the women blarg walk", "the muslims blarg walk", "the people blarg walk"])
    assert min(rude.values()) > 0.5


def test_terms_are_swapped_within_their_group():
    words = toxicity.words_of("Women and women, MEN.")
    assert toxicity.swapped(words, toxicity.IDENTITY_GROUPS, 0) == {"people": 3, "and": 1}
    assert toxicity.swapped(words, toxicity.IDENTITY_GROUPS, 1) == {"men": 2, "girls": 1, "and": 1}
    assert toxicity.swapped(toxicity.words_of("no one"), toxicity.IDENTITY_GROUPS, 1) is None


def test_held_out_accuracy_of_the_query(spark):
    from tracewright.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op12_toxicity"](spark, sf).collect()}
    docs = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(rows) == sorted(docs)
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= rows[i].score <= 1 and rows[i].predicted == (rows[i].score >= 0.7) for i in rows)
    held = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    clean = [r.predicted for r, y in held if y == 0]
    order = [(a.score > b.score) + 0.5 * (a.score == b.score) for a, x in held if x for b, y in held if not y]
    assert sum(clean) / len(clean) < 0.03 and sum(order) / len(order) > 0.8


def test_defined_cases(spark, labelled):
    model = toxicity.fit(labelled)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "Blarg snood wurgle blarg", None), (4, "the " * 400_000 + "blarg", "z")],
                                 "doc_id long, text string, bucket string")
    out = toxicity.score(docs, model).collect()
    assert [r.doc_id for r in out].count(2) == 2 and {round(r.score, 9) for r in out if r.doc_id in (1, 2)} == {round(next(r.score for r in out if r.doc_id == 1), 9)}
    assert next(r for r in out if r.doc_id == 3).predicted == 1 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="score"):
        toxicity.score(docs.withColumnRenamed("bucket", "Score"), model)
    empty = labelled.limit(0)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(empty)).collect()} == {0.0}
    one = toxicity.score(docs, toxicity.fit(labelled.filter("toxic = 1"))).collect()
    assert all(r.score > 0.9 for r in one)


def test_a_document_labelled_twice_is_toxic_if_any_label_says_so(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (None, "n"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.labelled_documents(docs, labels, F.lit(True)).collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", 0), ("b2", 0)]
