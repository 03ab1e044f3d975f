"""The registered queries of these operators and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return register


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import secret_scan
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(secret_scan.planted_findings(docs)))
    return found.select("doc_id", "start", F.char_length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"),
                        F.round("score", 6).alias("score"), "secret")


@query("op2_posting_lists")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import ann
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tracewright.llm import byte_bpe
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    back = byte_bpe.decode(byte_bpe.encode(docs, *vocab).drop("text"), *vocab)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_ngram_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import ngram_join
    return ngram_join.components_of(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import language_id
    docs = table(spark, sf_dir, "documents")
    known = language_id.learn(docs.filter(~language_id.held_out()))
    rows = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.identify(rows, known).drop("text")


#: A conversation whose texts are the markers of a common chat template.
CONTROL_STRINGS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op6_chat_format")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import chat
    from tracewright.llm.common import written
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL_STRINGS, "conv_id long, turn long, role string, text string"))
    formatted = written(chat.render(chat.fold(chat.log_of(rows))), "chat")
    return chat.digests(formatted)


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import packing
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), as_loaded=True))


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import token_files
    folder, manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, as_loaded=True)
    back = token_files.read_tokens(folder, manifest)
    return back.select("doc_id", "start", "n_tokens", token_files.crc32_of("ids").alias("ids_crc32"))


#: Host labels whose hosts are on the list that the cascade encodes (fixed values).
LISTED_LABELS = ["adult-x", "ads-track", "cheap-pills", "free-bets", "spam-farm"]


@query("op9_url_cascade", f"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] END, '') AS rest FROM pages),
keys AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM keys JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT k.page_id, host, path, rule, coalesce(verdict,
       CASE WHEN regexp_matches(host, '(^|\\.)({"|".join(LISTED_LABELS)})\\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM keys k LEFT JOIN fits f ON k.page_id IS NOT DISTINCT FROM f.page_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import url_cascade
    from tracewright.llm.url_cascade import Rule
    rules = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
             Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = url_cascade.hosts_with_labels(pages, LISTED_LABELS)
    return url_cascade.judge(pages, listed, rules)


@query("op10_digest_index", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import dedup_index
    out = dedup_index.add(dedup_index.DigestIndex(spark), table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op11_phrase_mining", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, CAST(len(ws) AS BIGINT) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, range(1, 6) AS ks(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 100),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
         FROM c, range(1, 5) AS t(cut), n, f l, f r
         WHERE cut < c.k AND n.lang = c.lang AND l.lang = c.lang AND r.lang = c.lang
           AND l.phrase = array_to_string(c.ws[1:cut], ' ') AND r.phrase = array_to_string(c.ws[cut + 1:], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (SELECT c.lang, c.a, unnest(list_transform(range(1, c.k - m + 2), lambda i: array_to_string(c.ws[i:i + m - 1], ' '))) AS phrase
                FROM c, range(2, 5) AS t(m) WHERE m < c.k),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * low.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import phrases
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import toxicity
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.held_out()
    model = toxicity.fit(toxicity.labelled_documents(docs, labels, ~out))
    return toxicity.score(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


def _codes_sql(rounds: int = 4) -> str:
    """The nearest entry of every part by all distances, `rounds` updates and a last assignment."""
    nearest = """SELECT vec_id, label, part, v, entry, d FROM (
  SELECT p.*, entry, CAST(list_inner_product(v, v) - 2 * list_inner_product(v, e) + list_inner_product(e, e) AS BIGINT) AS d FROM p JOIN b{i} USING (part))
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1"""
    steps = ["""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS v FROM k, range(4) AS r(part))",
             """b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS e FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256)"""]
    for i in range(rounds):
        steps += [f"n{i} AS MATERIALIZED ({nearest.format(i=i)})",
                  f"""m{i} AS (SELECT part, entry, list(x ORDER BY j) AS e FROM (
  SELECT part, entry, j, floor(sum(v[j]) / count(*)) AS x FROM n{i}, range(1, (SELECT max(len(v)) FROM p) + 1) AS c(j) GROUP BY part, entry, j) GROUP BY part, entry)""",
                  f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{i}.e, b{i}.e) AS e FROM b{i} LEFT JOIN m{i} USING (part, entry))"]
    steps += [f"last AS MATERIALIZED ({nearest.format(i=rounds)})",
              "c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id)",
              f"""h AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM b{rounds})"""]
    return ("WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h")


@query("op13_vector_codes", _codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import vector_codes
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))
