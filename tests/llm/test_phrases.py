"""Phrase mining against plain counts, with shards of any size."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import phrases

SCHEMA = "doc_id long, text string, lang string, words int, n int, phrase string, h long, gain long"


def plain(rows, support, top, most=5):
    f, n = {}, Counter()
    for _, text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[i:i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def mine(spark, rows, support, top=2000, shard_bytes=phrases.SHARD_BYTES):
    docs = spark.createDataFrame([(i, t, g, 1, 2, "x", 3, 4) for i, t, g in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.collocations(docs, support, top, shard_bytes=shard_bytes).collect()))


def corpus(seed=3, rows=120):
    rng = random.Random(seed)
    words = ["New", "york", "the", "of", "a", "b", "éa", "\U0001f600", "C"]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for _ in range(rng.randint(0, 60)))
    out = [(i, text(), rng.choice(["en", "de", None, "und"])) for i in range(rows)]
    return out + [(1000, None, "en"), (1001, "", None), (1002, " .\n!", "fr")] + [out[0]] * 30


@pytest.mark.parametrize("support,shard_bytes", [(8, 1 << 20), (5, 700), (30, 120)])
def test_equals_plain_counts(spark, support, shard_bytes):
    rows = corpus()
    got = mine(spark, rows, support, shard_bytes=shard_bytes)
    assert got == plain(rows, support, 2000) and len(got) > 10


def test_first_of_each_language_and_ties(spark):
    rows = corpus(5)
    assert mine(spark, rows, 4, top=7) == plain(rows, 4, 7)


def test_a_full_filter_changes_nothing(spark):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain_rows = docs.select("text", "lang")
    totals = {r.lang: r["sum(n)"] for r in phrases.word_counts(plain_rows).groupBy("lang").sum("n").collect()}
    hashes = phrases.candidates(phrases.mined(plain_rows, totals, 6, 8, 300), 6, 6, 8).filter("h is not null")
    few = phrases.candidate_filter(hashes, 64)
    assert len(few) == 1
    found = phrases.counted(plain_rows, few).filter("n >= 6 and words > 1")
    wide = phrases.counted(plain_rows, phrases.candidate_filter(hashes)).filter("n >= 6 and words > 1")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wide.collect())) != []


def test_overlaps_long_texts_and_empty_tables(spark):
    long = "x " * 200_000 + "." + "a b " * 1000
    got = mine(spark, [(1, long, "en")], 100, shard_bytes=10_000)
    assert ("en", "x x x x x", 199_996) in [(r[0], r[2], r[3]) for r in got]
    assert mine(spark, [], 2) == []
    assert mine(spark, [(1, None, None)], 1) == []


def test_levels_are_complete_in_a_shard():
    text = b"a b a b a\nb a c"
    found = {(k, b" ".join(w[i] for i in ids[p:p + k])): int(c) for k, _, counts, at, w, ids in phrases.levels(text, "en", lambda h, c: c >= 2) for p, c in zip(at, counts)}
    assert found == {(1, b"a"): 4, (1, b"b"): 3, (2, b"a b"): 2, (2, b"b a"): 3, (3, b"a b a"): 2}


def test_packed_numbers_come_back():
    import numpy as np
    for values in ([], [0], [1, 255, 256, 70_000, 2 ** 32 - 1]):
        assert phrases._unpacked(phrases._packed(np.array(values, np.int64))).tolist() == values


def test_rows_in_another_order_lose_no_candidate(spark, monkeypatch):
    rows = corpus(11)
    plain_words = phrases.word_counts
    # a slack that is too small by far, as if the shards had been others when it was computed
    monkeypatch.setattr(phrases, "word_counts", lambda rows, limit=0: plain_words(rows, 40))
    assert mine(spark, rows, 12, shard_bytes=1 << 20) == plain(rows, 12, 2000)


def test_counts_of_shards_travel_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(" ".join(f"w{i % 400} v{i % 397}" for i in range(4000)), "en")] * 12, "text string, lang string").repartition(6)
    sent, plain_map = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda *a, **k: sent.append(plain_map(*a, **k)) or sent[-1])
    found = phrases.counted(rows, np.full(1, 2 ** 64 - 1, np.uint64))  # a full filter: every phrase of every shard passes
    phrases_of_shards = 6 * found.count()
    assert sent[-1].count() <= 6 * 5 * 256 < phrases_of_shards
    assert found.groupBy().sum("n").first()[0] == 12 * sum(8000 - k for k in range(5))
