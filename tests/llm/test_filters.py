"""Dedup index, URL cascade, secret scan and language ID."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tracewright.llm import dedup_index, language_id, secret_scan, url_cascade
from tracewright.llm.url_cascade import Rule


def normal(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


DOCS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\n\tb"), (5, None), (6, ""), (7, " \n"), (None, "ab c"), (8, "é x"), (9, "éx"), (10, "z" * 200_000), (11, "z " * 200_000),
        (12, "once"), (12, "once"), (13, "\xa0ab")]


def wanted(rows):
    best, size = {}, {}
    for k, t in rows:
        h = normal(t)
        size[h] = size.get(h, 0) + 1
        best[h] = min(best.get(h, (1, None, None)), (-len(t or ""), k is None, k or 0))
    return {(k, None if best[h][1] else best[h][2], size[h], k == (None if best[h][1] else best[h][2]), h) for k, t in rows for h in [normal(t)]}


def test_dedup_of_one_batch(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("digest", F.lit("own")).withColumn("kept", F.lit(0)).repartition(4)
    out = dedup_index.add(dedup_index.DigestIndex(spark), docs).collect()
    assert len(out) == len(DOCS)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in out} == wanted(DOCS)


def test_index_is_found_again_and_grows(spark, tmp_path):
    path = str(tmp_path / "index")
    first = spark.createDataFrame([(1, "ab"), (2, "c")], "doc_id long, text string")
    dedup_index.add(dedup_index.DigestIndex(spark, path, buckets=4), first).collect()
    later = dedup_index.DigestIndex(spark, path, buckets=4)
    second = spark.createDataFrame([(3, "a b"), (4, "d"), (5, "d")], "doc_id long, text string")
    out = {r.doc_id: (r.keep_id, r.kept) for r in dedup_index.add(later, second).collect()}
    assert out == {3: (1, False), 4: (4, True), 5: (4, False)}
    assert sorted(r.keep_id for r in later.read().collect()) == [1, 2, 4]
    dedup_index.add(later, second).collect()
    assert later.read().count() == 3


def test_the_index_is_not_shuffled_for_the_anti_join(spark):
    index = dedup_index.DigestIndex(spark)
    index.append(dedup_index.groups(dedup_index.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))))
    found = dedup_index.groups(dedup_index.digests(spark.createDataFrame([(2, "b")], "doc_id long, text string")))
    plan = index.unknown(found)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_keep_new_keeps_rows_as_they_are(spark):
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(DOCS)], "doc_id long, text string, digest int")
    out = dedup_index.keep_new(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    keeps = [k for k, keep, _, is_kept, _ in wanted(DOCS) if is_kept]
    assert sorted(set(kept), key=str) == sorted(set(keeps), key=str)
    assert dedup_index.keep_new(docs.limit(0)).count() == 0


URLS = ["http://Www.Example.COM/en/x?y#z", "https://a.example.com/en/", "https://a.example.com/fr/", "ftp://b.net/es/1", "x://net/fr/", "http://bnet/es/",
        "http://spam-farm.example.org/", "http://ok.example.org#/es/", "http://ok.example.org?a/b", None, "", "no scheme", "http://", "a://b://c/d", "http://É.net/es/é", "http://u@h.com:80/p"]
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def judged(url):
    rest = url.partition("://")[2] if url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    listed = host.startswith("spam-farm.")
    return host, path, rule and rule.name, rule.verdict if rule else "block" if listed else "allow"


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_judge(spark, most):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").withColumn("host", F.lit("own"))
    listed = url_cascade.hosts_with_labels(pages, ["spam-farm"])
    out = url_cascade.judge(pages, listed, RULES, most).collect()
    assert len(out) == len(URLS) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == judged(URLS[r.page_id]) for r in out)
    assert url_cascade.judge(pages.limit(0), listed, RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    for modulus in (3, 50, 1):
        listed = universe.filter(f"pmod(hash(key), {modulus}) = 0")
        cascade = url_cascade.build(listed, universe)
        assert cascade.levels and len(cascade.levels) < 40
        wrong = universe.withColumn("in", cascade.listed(F.col("key"))).filter(F.col("in") != F.expr(f"pmod(hash(key), {modulus}) = 0"))
        assert wrong.count() == 0
    assert url_cascade.build(universe.limit(0), universe).levels == []


SECRET = hashlib.sha1(b"x").hexdigest()


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.fit(secret_scan.planted_findings(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))


def test_positions_of_candidates(spark):
    texts = [f'é token = "{SECRET}" and {SECRET} 🙂 {SECRET}.', None, "", "no digits here_in_this_long_word", "short 123", "1234567890123456", f"{SECRET} " * 50]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumn("value", F.lit(1))
    out = secret_scan.with_candidates(docs).collect()
    assert len(out) == 3 + 1 + 50
    for r in out:
        t = texts[r.doc_id]
        assert t[r.start:r.start + len(r.value)] == r.value
        assert r.left == t[:r.start][-60:].removeprefix(SECRET) or t[:r.start].endswith(r.left)
        assert t[r.start + len(r.value):].startswith(r.right)
    assert len({(r.doc_id, r.start) for r in out}) == len(out)


@pytest.mark.parametrize("text, value, left", [
    ("my password: hunter2, ok", "hunter2", "my password: "), ('"pwd": "Tr0ub4dor&3"', "Tr0ub4dor&3", '"pwd": "'), ("secret = 'two words'", "two words", "secret = '"),
    ("see QwErTyUiOpAsDfGhJkLz.", "QwErTyUiOpAsDfGhJkLz", "see "), ("PASSWORD=Xk3abcDEF456ghiJKL\n", "Xk3abcDEF456ghiJKL", "PASSWORD="),
    ("x?token=abc123DEF456ghi789&y", "abc123DEF456ghi789", "x?token="), ("KEY=abc123DEF456ghi789==", "abc123DEF456ghi789==", "KEY="),
    ("at /hooks/abc123DEF456ghi789/x", "abc123DEF456ghi789/x", "at /hooks/"), ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYzz", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzz", ""),
    ("Authorization: Bearer abcdef", "abcdef", "Authorization: Bearer ")])
def test_candidates_by_context(spark, text, value, left):
    found = secret_scan.with_candidates(spark.createDataFrame([(1, text, "p")], "doc_id long, text string, source string")).collect()
    assert [(r.value, r.left, r.start) for r in found] == [(value, left, len(left))]


def test_short_secrets_are_masked_in_their_places(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "scan", lambda docs, forest, *cols: secret_scan.with_candidates(docs, *cols).withColumn("secret", F.lit(True)))
    texts = ["a password: a, then a and pwd=b; é🙂 pwd='c'", "no b password=b"]
    docs = spark.createDataFrame([(1, t, None) for t in texts], "doc_id long, text string, source string")
    got = sorted(r.text for r in secret_scan.redact(docs, None).collect())
    assert got == ["a password: [SECRET], then a and pwd=[SECRET]; é🙂 pwd='[SECRET]'", "no b password=[SECRET]"]


def test_forest_on_planted_findings_it_has_not_seen(spark, forest):
    fresh = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id >= 500")
    from pyspark.ml.functions import vector_to_array
    judged = forest.transform(secret_scan._assembled(secret_scan.planted_findings(fresh)))
    right = judged.select(((vector_to_array("probability")[1] >= 0.5) == (F.col("label") == 1)).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.95


def test_forest_on_surroundings_it_has_not_seen(spark):
    """Each third of the templates is held out once; labels, values and documents of the held-out part are new to the forest."""
    from pyspark.ml.functions import vector_to_array
    seen, fresh = (spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(f) for f in ("doc_id < 500", "doc_id >= 500"))
    n, both, said, are = 0, 0, 0, 0
    for part in range(3):
        held = [t for i, t in enumerate(secret_scan.SURROUNDINGS) if i % 3 == part]
        model = secret_scan.fit(secret_scan.planted_findings(seen, surroundings=[t for t in secret_scan.SURROUNDINGS if t not in held]))
        planted = secret_scan.planted_findings(fresh, 1500, held)
        judged = model.transform(secret_scan._assembled(planted)).select("label", (vector_to_array("probability")[1] >= secret_scan.THRESHOLD).alias("s"))
        r = judged.agg(F.count("*"), F.count_if(F.expr("s AND label = 1")), F.count_if("s")).first()
        # planted secrets that are no candidates count as missed
        n, both, said, are = n + r[0], both + r[1], said + r[2], are + 1500 // len(held) * sum(t[0] for t in held)
    print("held-out templates:", n, "findings, recall", both / are, "precision", both / said)
    assert both / are >= 0.8 and both / said >= 0.8


def test_redaction(spark, forest):
    texts = [f'it was token = "{SECRET}" then', "card 4012429011158754 on", None, "", f"commit {SECRET} is", f'it was token = "{SECRET}" then']
    docs = spark.createDataFrame([(i if i < 5 else 0, t, None, 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    out = secret_scan.redact(docs, forest)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    masked = texts[0].replace(SECRET, secret_scan.MASK)
    assert got == sorted([(0, masked, len(masked)), (0, masked, len(masked)), (1, texts[1], 7), (2, None, 7), (3, "", 7), (4, texts[4], 7)], key=str)
    assert secret_scan.redact(docs.limit(0), forest).count() == 0


def test_language_profiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language_id.learn(docs.filter(~language_id.held_out()))
    assert sorted(known) == ["de", "en", "es", "fr"]
    out = language_id.identify(docs.filter(language_id.held_out()), known)
    right = out.filter("lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 🙂"), (4, "a"), (5, "the " * 50_000), (5, "the " * 50_000)], "doc_id long, text string").withColumn("lang", F.lit("zz"))
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(odd, known).collect())
    assert [x[1] for x in got[:3]] == ["und"] * 3 and [x[2] for x in got[:3]] == [0.0] * 3
    assert got[3][1] != "und" and got[4][1:] == got[5][1:] and got[4][1] == "en" and all(0 <= x[2] <= 1 for x in got)
    assert language_id.identify(odd.limit(0), known).count() == 0
    assert language_id.learn(odd.limit(0)) == {} and language_id.identify(odd, {}).filter("lang_pred != 'und'").count() == 0


def test_language_of_a_text_is_the_cosine_of_bundled_vectors(spark):
    import numpy as np
    known = {"aa": np.ones(language_id.DIMENSIONS), "bb": -np.arange(language_id.DIMENSIONS) + 0.0}
    text = "Höher, als der  Wald!"
    symbols = [0] + [int(language_id._symbols()[ord(c)]) for c in text] + [0]
    run = [s for i, s in enumerate(symbols) if s or i == 0 or symbols[i - 1]]
    bundle = sum(language_id.trigram_vectors(np.array([(a * 64 + b) * 64 + c]))[0].astype(int) for a, b, c in zip(run, run[1:], run[2:]))
    cosine = {k: bundle @ v / np.linalg.norm(bundle) / np.linalg.norm(v) for k, v in known.items()}
    r = language_id.identify(spark.createDataFrame([(text,)], "text string"), known).first()
    best = max(cosine, key=cosine.get)
    assert r.lang_pred == best and r.score == pytest.approx(max(0, cosine[best]), abs=1e-4)


def test_sql_agrees(spark):
    import duckdb
    from tracewright.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.execute(sql).fetchall()
        columns = [d[0] for d in con.description]
        assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want)), name


def test_long_texts_with_many_matches_and_names(spark, monkeypatch):
    import random
    import time
    rng = random.Random(2)
    keys = ["".join(rng.choice("abcdefghijkLMNOPQ0123456789") for _ in range(20)) + "7" for _ in range(500)]
    pieces, places, at = [], [], 0
    for i in range(60_000):
        word = "w" * rng.randrange(3, 40) + (" é " if i % 3 else " tion/ers/")
        at += len(word)
        pieces.append(word)
        places.append(at)
        pieces.append(keys[i % 500])
        at += 21
        pieces.append(" ")
        at += 1
    many, deep = "".join(pieces), "see " + "abcd/" * 100_000 + keys[0] + " and token=" + keys[1]
    short = "see " + "abcd/" * 3000 + "abc9"
    docs = spark.createDataFrame([(1, many, "a"), (2, deep, "b"), (3, short, "c"), (4, "abc/" * 500 + "x", None)], "doc_id long, text string, source string")
    before = time.monotonic()
    found = secret_scan.with_candidates(docs).select("doc_id", "start", "value", "left").collect()
    assert time.monotonic() - before < 120
    got = sorted(r.start for r in found if r.doc_id == 1)
    assert got == places and all(many[r.start:r.start + len(r.value)] == r.value for r in found if r.doc_id == 1)
    assert sorted((r.start, r.value) for r in found if r.doc_id == 2) == [(4 + 500_000, keys[0]), (len(deep) - 21, keys[1])]
    assert not [r for r in found if r.doc_id > 2]
    monkeypatch.setattr(secret_scan, "EVERYWHERE", 10**6)
    monkeypatch.setattr(secret_scan, "scan", lambda docs, forest, *cols: secret_scan.with_candidates(docs, *cols).withColumn("secret", F.lit(True)))
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs, None).collect()}
    import re
    assert masked[1] == re.sub("|".join(keys), "[SECRET]", many)
    assert masked[2] == deep.replace(keys[0], "[SECRET]").replace(keys[1], "[SECRET]") and masked[3] == short


HELPERS = ["key", "row", "of", "nths", "values", "t", "gaps", "parts", "pieces", "clean", "found", "heads", "pairs", "split", "sizes", "inner", "bases", "_key", "_id", "_places",
           "_values", "_kept_id", "_kept_digest", "_lang", "_score", "doc_id_", "nth", "start", "value", "left", "right", "path", "digest", "keep_id", "chars", "component_id", "rep", "n",
           "label", "score", "lang_pred", "features", "secret", "group_size", "kept", "piece", "length", "ids_crc32", "sequence_id", "offset", "gap"]


def test_stages_leave_columns_of_any_name_alone(spark):
    import corpus_pipeline
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = base.withColumns({c: F.concat(F.lit(c + "-"), F.col("doc_id").cast("string")) for c in HELPERS})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.select("doc_id", *HELPERS).collect()
        assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in HELPERS), name
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, base, "").select("doc_id").collect()), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() > 0
