"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is what is assigned to a secret word, of any length, or a run of 16
or more key characters with a digit or a change from small letters to capitals
in it; names before a run ("KEY=", "path/") are its left context. The forest judges it by its length, the transitions between its characters, how
much of it dictionary words cover, its path and the words beside it. It is
fitted on labelled findings, a bounded table; everything else covers all rows.
Only DataFrame functions and Spark's own forest are used.

Defined results: null and empty texts have no candidates; every occurrence is a
finding of its own, in texts of any length; repeated rows have their findings
repeated; a null path counts as empty; an empty table has no findings; columns
other than those named are not read, whatever they are called.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import local_table, text_or_empty, written

#: Characters kept on either side.
LEFT, RIGHT = 60, 30
#: Rows of labelled findings that the forest is fitted on at most, and its size.
LABELLED_ROWS, TREES, DEPTH, SEED = 6000, 24, 8, 42
#: A finding is a secret from this share of the trees' votes on.
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Shorter secrets are masked only in the places found.
EVERYWHERE = 16

#: Words of placeholders, code and prose (fixed values).
DICTIONARY = ("example placeholder changeme dummy sample fixture password secret token access private public account user admin test demo "
              "your here insert replace value string default null none true false key api auth client server service config data name file "
              "path image version release build update model batch page index table query field item list order date time year month "
              "report document section chapter commit branch merge with from that this have will been which their what the and for").split()
#: Words beside a secret and beside what only looks like one (fixed values).
SECRET_WORDS = "token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private|client.?key"
HARMLESS_WORDS = "commit|sha-?1|sha-?256|md5|checksum|digest|etag|uuid|guid|build|version|revision|trace|request.?id|order|invoice|file|image|page"
PATH_WORDS = "test|example|sample|fixture|mock|demo|docs?/|readme"
KEY = "A-Za-z0-9_+/-"
#: What is assigned: secret word, the rest of the name, = or :, the value in quotes or up to a blank or mark. Group 1 is not the value.
_ASSIGNED = (rf"((?i:{SECRET_WORDS})[A-Za-z0-9_.-]{{0,24}}[\"'`\]]{{0,2}}[ \t]{{0,4}}(?:=>|:=|[=:])[ \t]{{0,4}}(?:(?i:bearer|basic|token)[ \t]{{1,4}})?[\"'`]?)"
             r"(?:(?<=\")[^\"\r\n]+(?=\")|(?<=')[^'\r\n]+(?=')|(?<=`)[^`\r\n]+(?=`)|[^\s\"'`,;&<>(){}\[\]]+)")
#: A run that stands alone, after names with a / (group 2), with its padding.
#: Of its names the pattern takes NAMES at most, as each costs stack of the matcher; further ones are cut off afterwards.
NAMES = 300
_NAME = "[A-Za-z][a-z_-]{2,}"
_REST = rf"(?:(?=[A-Za-z_+/-]*[0-9])|(?=[A-Z_+/-]*[a-z][a-z_+/-]*[A-Z]))[{KEY}]{{16,}}={{0,2}}"
_RUN = rf"(?<![{KEY}])((?>(?:/{{0,2}}(?:{_NAME}/){{1,{NAMES}}})?+)){_REST}"
CANDIDATE = f"{_ASSIGNED}|{_RUN}"
_WORDS = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))


#: Matches whose places are summed up at a time.
_CHUNK = 512


def _fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, also where a later lambda uses them for each element."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _parts(rows: DataFrame) -> DataFrame:
    """For rows with a text t that has a match: gaps (text before each match and after the last) and parts (name, value of each); t goes."""
    each = lambda group: F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(group))
    found = _fixed(rows, found=each(0), heads=F.zip_with(each(1), each(2), lambda a, b: F.concat(a, b)), gaps=F.split("t", CANDIDATE, -1))
    pairs = _fixed(found.drop("t").filter(F.size("found") > 0), pairs=F.zip_with("found", "heads", lambda m, h: F.struct(
        h.alias("name"), F.substr(m, F.char_length(h) + 1).alias("value")))).drop("found", "heads")

    def names(value: Column) -> Column:
        steps = F.split(value, "/")
        first = F.array_position(F.transform(steps, lambda x: x.rlike(f"^{_NAME}$")), F.lit(False))
        n = F.when(first > 0, first - 1).otherwise(F.size(steps) - 1).cast("int")
        return F.when(n > 0, F.concat(F.array_join(F.slice(steps, F.lit(1), n), "/"), F.lit("/"))).otherwise(F.lit(""))
    more = lambda p: F.when(F.char_length(p["name"]) >= 4 * NAMES, names(p["value"])).otherwise(F.lit(""))
    split = _fixed(pairs, split=F.transform("pairs", lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), more(p).alias("more")))).drop("pairs")
    return _fixed(split, parts=F.transform("split", lambda p: F.struct(
        F.concat(p["name"], p["more"]).alias("name"), F.substr(p["value"], F.char_length(p["more"]) + 1).alias("value")))).drop("split")


def with_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: doc_id, path, start (from 0), value, left, right, nth (number of the match in its text).

    Places are sums over the matches before, taken in chunks, and a match leaves its text's arrays with its own part only.
    """
    rows = _parts(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), text_or_empty(text_col).alias("t")))
    size = lambda p, i: (F.char_length(F.get("gaps", i)) + F.char_length(p["name"]) + F.char_length(p["value"])).cast("long")
    sums = lambda items, of: F.aggregate(items, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + of(x))))
    rows = _fixed(rows, sizes=F.transform("parts", size))
    rows = _fixed(rows, inner=F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / _CHUNK)), lambda c: sums(
        F.slice("sizes", (c * _CHUNK + 1).cast("int"), F.lit(_CHUNK)), lambda x: x))).drop("sizes")
    rows = _fixed(rows, bases=sums(F.col("inner"), lambda x: F.element_at(x, -1)))

    def one(p: Column, i: Column) -> Column:
        chunk = F.floor(i / _CHUNK).cast("int")
        before = F.get("bases", chunk) + F.get(F.get("inner", chunk), (i - chunk * _CHUNK).cast("int"))
        return F.struct((before + F.char_length(F.get("gaps", i)) + F.char_length(p["name"])).alias("start"), p["value"].alias("value"),
                        F.right(F.concat(F.get("gaps", i), p["name"]), F.lit(LEFT)).alias("left"),
                        F.left(F.concat(F.get("gaps", i + 1), F.coalesce(F.get("parts", i + 1)["name"], F.lit(""))), F.lit(RIGHT)).alias("right"),
                        i.cast("int").alias("nth"), (F.char_length(p["name"]) < 4 * NAMES).alias("plain"))
    found = rows.select("doc_id", "path", F.inline(F.transform("parts", one)))
    return found.filter(F.col("plain") | F.col("value").rlike(f"^{_REST}$")).drop("plain")


def features() -> dict[str, Column]:
    """Name -> number, from value, left, right and path."""
    value, n = F.col("value"), F.char_length("value").cast("double")
    low = F.lower(value)
    # v vowel, c consonant, U capital, d digit, s other
    kinds = F.translate(value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/=-",
                        "vcccvcccvcccccvcccccvccccc" + "U" * 26 + "d" * 10 + "s" * 5)
    share = lambda pattern: F.regexp_count(kinds, F.lit(pattern)) / n
    chars = F.split(value, "")
    counts = F.transform(F.array_distinct(chars), lambda x: F.size(F.array_remove(chars, x)))
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, rest: a - (n - rest) / n * F.log2((n - rest) / n))
    left, right, path = F.lower("left"), F.lower("right"), F.lower("path")
    number = lambda c: c.cast("double")
    return {
        "length": n, "entropy": entropy, "distinct": F.size(F.array_distinct(chars)) / n,
        "digits": share("d"), "capitals": share("U"), "marks": share("s"),
        "to_digit": share("(?=[vcU]d)"), "from_digit": share("(?=d[vcU])"), "case_change": share("(?=[vc]U)"),
        "vowel_turns": share("(?=vc|cv)"), "consonant_runs": share("(?=ccc)"), "digit_runs": share("(?=ddd)"),
        "same": F.regexp_count(value, F.lit(r"(.)(?=\1)")) / n, "steps": F.regexp_count(low, F.lit("(?=12|23|34|45|56|67|78|89|ab|bc|cd|de|ef)")) / n,
        "hex": number(low.rlike("^[0-9a-f]+$")), "digits_only": number(value.rlike("^[0-9]+$")),
        "dictionary": 1 - F.char_length(F.regexp_replace(low, _WORDS, "")) / n,
        "path_harmless": number(path.rlike(PATH_WORDS)), "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "near_secret": F.regexp_count(left, F.lit(SECRET_WORDS)).cast("double"), "near_harmless": F.regexp_count(left, F.lit(HARMLESS_WORDS)).cast("double"),
        "assigned": number(left.rlike(r"[=:]\s*[\"'`]?$")), "quoted": number(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        "last_word_secret": number(left.rlike(rf"(?:{SECRET_WORDS})\w*\W{{0,6}}$")), "runs_on": number(right.rlike(r"^[@.][a-z0-9]")),
    }


def _assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    own = features()
    wide = rows.withColumns({f"f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in own.items()})
    return VectorAssembler(inputCols=[f"f_{k}" for k in own], outputCol="features").transform(wide)


def fit(labelled: DataFrame):
    """A forest from labelled findings: value, left, right, path, label (1: a secret). At most LABELLED_ROWS rows are used.

    None where there are not both kinds to learn from; nothing counts as a secret then.
    """
    from pyspark.ml.classification import RandomForestClassifier
    rows = written(labelled.select("value", "left", "right", "path", F.col("label").cast("double").alias("label"))
                   .orderBy(F.xxhash64("value", "left")).limit(LABELLED_ROWS), "labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(_assembled(rows))


def scan(docs: DataFrame, forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Findings: doc_id, start, value, score, secret, nth. The score is the forest's share of votes for a secret."""
    from pyspark.ml.functions import vector_to_array
    found = with_candidates(docs, id_col, text_col, path_col)
    if forest is None:
        return found.select("doc_id", "start", "value", F.lit(0.0).alias("score"), F.lit(False).alias("secret"), "nth")
    judged = forest.transform(_assembled(found))
    score = vector_to_array("probability")[1]
    return judged.select("doc_id", "start", "value", score.alias("score"), (score >= THRESHOLD).alias("secret"), "nth")


def redact(docs: DataFrame, forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """`docs` with every secret found in a text replaced by MASK; no row is lost, and n_chars is counted anew where there is one.

    A secret of EVERYWHERE or more characters is also replaced where it stands in other surroundings. Only documents with a
    candidate are shuffled.
    """
    has = F.coalesce(F.col(text_col).rlike(CANDIDATE), F.lit(False))
    # rows may share an id: matches belong to a text; columns travel under numbers, so that no name can clash
    key = F.to_json(F.struct(F.col(id_col), F.sha2(F.col(text_col), 256), F.col(path_col)))
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    back = lambda rows, **changed: rows.select(*[changed.get(c, F.col(n)).alias(c) for c, n in own.items()])
    suspects = docs.filter(has).select(key.alias("key"), *[F.col(c).alias(n) for c, n in own.items()])
    texts = suspects.select("key", F.col(own[text_col]).alias("text"), F.col(own[path_col]).alias("source"))
    size = F.char_length("value")
    found = (scan(texts, forest, "key", "text", "source").filter("secret").groupBy(F.col("doc_id").alias("of"))
             .agg(F.array_sort(F.collect_set("nth")).alias("nths"),
                  F.array_sort(F.collect_set(F.when(size >= EVERYWHERE, F.col("value"))), lambda a, b: F.length(b) - F.length(a)).alias("values")))
    clear = back(suspects.join(found, F.col("key") == F.col("of"), "left_anti"))
    hit = _parts(suspects.join(found, F.col("key") == F.col("of")).drop("key", "of").withColumn("t", F.col(own[text_col])))
    # name and value of each match behind the text before it, then the text that is left
    pieces = F.concat(F.flatten(F.transform("parts", lambda p, i: F.array(F.concat(F.get("gaps", i), p["name"]), p["value"]))), F.array(F.element_at("gaps", -1)))
    hit = _fixed(hit, pieces=pieces).drop("parts", "gaps")
    after = lambda i: F.coalesce(2 * F.get("nths", i - 1) + 2, F.lit(0))  # noqa: E731 - first piece behind the secret before
    kept = F.concat(F.transform("nths", lambda n, i: F.array_join(F.slice("pieces", after(i) + 1, 2 * n + 1 - after(i)), "")),
                    F.array(F.array_join(F.slice("pieces", 2 * F.element_at("nths", -1) + 3, F.size("pieces")), "")))
    clean = _fixed(hit, clean=F.aggregate("values", F.array_join(kept, MASK), lambda t, v: F.replace(t, v, F.lit(MASK))))
    changed = {text_col: F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
    masked = back(clean, **changed)
    return docs.filter(~has).unionByName(clear).unionByName(masked)


#: Surroundings of planted findings: label, path, kinds of value, text before, text after (fixed values). Formats of
#: configuration, code, requests, logs and prose; every kind and every format stands on both sides where that makes sense.
_RANDOM, _SHORT, _NOT_KEYS = "hex40 HEX40 hex32 mixed40 mixed24 letters24 prefixed", "short phrase", "words placeholder repeated camel reference"
SURROUNDINGS = [
    (1, "config/app.json", _RANDOM, '{"api_key": "', '", "id": 7}'), (1, "", _RANDOM, '"clientSecret":"', '"}'), (1, "deploy/values.yaml", _RANDOM, "\n  auth_token: ", "\n  port: 80"),
    (1, "deploy/prod.env", _RANDOM, "\nDB_PASSWORD=", "\nHOST=a"), (1, "", _RANDOM, "export SECRET_KEY=", "\n"), (1, "", _RANDOM, "https://host.example.org/v1?access_key=", "&page=2"),
    (1, "", _RANDOM, "Authorization: Bearer ", "\n"), (1, "", _RANDOM, "X-Api-Key: ", "\nAccept: */*"), (1, "src/main.rs", _RANDOM, 'let secret = "', '";'),
    (1, "lib/client.js", _RANDOM, "const apiToken = '", "';"), (1, "", _RANDOM, "client --token=", " --quiet"), (1, "", _RANDOM, "the private key is: ", " and works"),
    (1, "conf/db.properties", _RANDOM, "jdbc.credential=", "\n"), (1, "", _RANDOM, "SECRET := `", "`"), (1, "", _RANDOM, "** AUTH KEY: '", "' **"), (1, "", _RANDOM, "| token = ", " |"),
    (1, "", "prefixed mixed40", "", " "), (1, "", "prefixed", "use ", " from now on"), (1, "logs/a.log", "prefixed", "sent header ", "\n"),
    (1, "", _SHORT, "password: ", "\n"), (1, "", _SHORT, '"passwd": "', '",'), (1, "", _SHORT, "login with password='", "'"), (1, "app/settings.py", _SHORT, 'DB_PASSWORD = "', '"\n'),
    (0, "", "hex40 hex32", "commit ", " fixes it"), (0, "", "hex40 hex32 HEX40", "sha256: ", "\n"), (0, "", "hex32 HEX40", "md5 checksum = '", "'"), (0, "", "hex40 hex32", '"etag": "', '",'),
    (0, "", "hex40 mixed40", "integrity digest ", " ok"), (0, "", "uuid", "request id ", ", "), (0, "", "uuid hex32", "trace=", " level=info"), (0, "", "uuid hex32", '"guid": "', '"'),
    (0, "", "hex40", "/revision/", "/diff "), (0, "", "hex32 words", "/image/", ".png "), (0, "", "version words", "build ", " is out"), (0, "", "version", "release: ", "\n"),
    (0, "", "digits", "order ", " "), (0, "", "digits", "call ", ". "), (0, "", "digits", "", " and"), (0, "", "digits", "invoice: ", "\n"), (0, "", "mail", " ", "@corp.example.net "), (0, "", "mail", "write to ", "@box.example.org. "),
    (0, "", "words camel", "", " "), (0, "", "camel", "call ", "() again"), (0, "", "words", "https://host.example.org/", "/index.html "), (0, "", "words camel", "see ", ", then"),
    (0, "", _NOT_KEYS, 'password: "', '"'), (0, "", _NOT_KEYS, "\nAPI_KEY=", "\n"), (0, "docs/readme.md", _NOT_KEYS, 'api_key = "', '" '), (0, "", _NOT_KEYS, '{"secret": "', '"}'),
    (0, "", _NOT_KEYS, "const token = '", "';"), (0, "", "plain reference", "the token: ", " of it"), (0, "", "plain", "author: ", ", a"), (0, "", "plain", "secret = ", " + 1"), (0, "", "plain", "password: ", " must be set"),
    (0, "tests/fixtures/keys.py", _RANDOM, 'token = "', '" '), (0, "examples/sample.json", _RANDOM, '{"api_key": "', '"}'), (0, "docs/mock.md", _RANDOM, "password: ", "\n"),
]


def planted_findings(docs: DataFrame, rows: int = LABELLED_ROWS, surroundings: list[tuple] = SURROUNDINGS) -> DataFrame:
    """Labelled findings: values of known kind in known surroundings, after words of the corpus's own documents.

    Takes rows / len(surroundings) documents by the hash of their id; the labels hold by construction.
    """
    carriers = (docs.select(F.xxhash64("doc_id").alias("h"), F.substring(text_or_empty(), 1, 200).alias("t"))
                .orderBy("h").limit(max(1, rows // len(surroundings))))
    spark = docs.sparkSession
    around = F.broadcast(local_table(spark, [(i, *s) for i, s in enumerate(surroundings)], "k int, label int, path string, own string, before string, after string"))
    each = carriers.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(surroundings) - 1)))).join(around, "k")
    own = F.split("own", " ")
    each = each.withColumn("kind", F.element_at(own, (F.pmod(F.xxhash64("h", "k"), F.size(own)) + 1).cast("int")))
    seed = F.concat_ws("-", F.col("h").cast("string"), F.col("k").cast("string"))
    hexa = F.sha2(seed, 256)
    mixed = F.translate(F.base64(F.unhex(F.concat(hexa, F.sha2(hexa, 256)))), "\r\n", "")
    words = F.filter(F.split(F.lower(F.regexp_replace("t", "[^A-Za-z ]", " ")), " +"), lambda w: F.length(w) > 2)
    some = F.array_join(F.slice(words, 2, 4), "-")
    kinds = {
        "hex40": F.left(hexa, F.lit(40)), "HEX40": F.upper(F.left(hexa, F.lit(40))), "hex32": F.left(hexa, F.lit(32)),
        "mixed40": F.left(mixed, F.lit(40)), "mixed24": F.left(F.translate(mixed, "+/", "-_"), F.lit(24)),
        "prefixed": F.concat(F.element_at(F.array(*map(F.lit, ("AKIA", "ghp_", "sk-", "xoxb-"))), (F.pmod("h", F.lit(4)) + 1).cast("int")),
                             F.left(F.translate(mixed, "+/=", "xyz"), F.lit(36))),
        "uuid": F.concat_ws("-", *(F.substring(hexa, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        "words": F.concat(some, F.lit("-"), F.pmod("h", F.lit(9000)).cast("string")), "digits": F.left(F.translate(hexa, "abcdef", "123456"), F.lit(16)),
        "placeholder": F.element_at(F.array(*map(F.lit, ("your_api_key_here_123", "INSERT_TOKEN_HERE_0000", "changeme-password-1234", "example-secret-key-12345"))),
                                    (F.pmod("h", F.lit(4)) + 1).cast("int")),
        "mail": F.concat(F.translate(some, "-", "."), F.pmod("h", F.lit(99)).cast("string")), "repeated": F.repeat(F.lit("x1"), 12),
        "letters24": F.left(F.concat(F.regexp_replace(mixed, "[^A-Za-z]", ""), F.lit("QwErTyUiOpAsDfGhJkLzXcVb")), F.lit(24)),
        "short": F.concat(F.initcap(F.left(F.coalesce(F.get(words, F.lit(2)), F.lit("pass")), F.lit(6))), F.left(F.translate(hexa, "abcdef", "!7&x#4"), F.lit(4))),
        "phrase": F.concat(F.left(F.coalesce(F.get(words, F.lit(3)), F.lit("hunt")), F.lit(7)), F.pmod("h", F.lit(999)).cast("string")),
        "camel": F.concat(F.lit("get"), F.replace(F.initcap(F.array_join(F.slice(words, 2, 3), " ")), F.lit(" "), F.lit("")), F.lit("ByTagName")),
        "reference": F.element_at(F.array(*map(F.lit, ("config.token", "null", "$SECRET_KEY", "os.environ"))), (F.pmod("h", F.lit(4)) + 1).cast("int")),
        "plain": F.coalesce(F.get(words, F.lit(1)), F.lit("some")),
        "version": F.concat(F.lit("release-build-"), F.pmod("h", F.lit(100000)).cast("string")),
    }
    value = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in kinds.items()))
    before = F.concat(F.right("t", F.lit(40)), F.lit(" "), F.col("before"))
    planted = each.select("k", "h", "path", "label", value.alias("planted"), before.alias("b"), F.concat("after", "t").alias("a"))
    # as a text, so that a finding has the value and context that the scan will see
    texts = planted.select(F.struct("label", F.char_length("b").alias("at"), "planted").alias("doc_id"), F.concat("b", "planted", "a").alias("text"), "path")
    found = with_candidates(texts, path_col="path")
    return (found.filter((F.col("start") == F.col("doc_id.at")) & (F.col("value") == F.col("doc_id.planted")))
            .select("value", "left", "right", "path", F.col("doc_id.label").alias("label")))
