"""Evidence: selections, export row sets, disclosure merges, dataset checks."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tracewright.operators.keys import events_per_key
from tracewright.operators.ordered import newest_per_key
from tracewright.plans import evidence
from tracewright.schemas import STREAM_KEY
from tracewright.session import checkpoint_root, durable
from tracewright.sources.readers import read_keys, read_record_jsonl, read_witnesses
from tracewright.sources.sinks import anchor_checkpoints, checkpoint_line, key_line, record_line
from tracewright.suite import data
from tracewright.suite.registry import query
from tracewright.suite.sql import CHAIN, WITH_AV, tagged

_TEXT = "cast(null as string)"


def _selections(spark, sf) -> DataFrame:
    """By sequence for one stream, by time for another, and three that are refused."""
    base = data.streams(spark, sf).select(*STREAM_KEY)
    return base.where("stream = 'click'").selectExpr(
        "'by_sequence' as selection_id", *STREAM_KEY, f"{_TEXT} as since", f"{_TEXT} as until", "61L as from_sequence",
        "120L as to_sequence").unionByName(base.where("stream = 'view'").selectExpr(
            "'by_time' as selection_id", *STREAM_KEY, "'2024-01-10T00:00:00.000000Z' as since", "'2024-01-12T00:00:00.000000Z' as until",
            "cast(null as long) as from_sequence", "cast(null as long) as to_sequence")).unionByName(
        base.where("stream = 'error'").selectExpr(
            "'both' as selection_id", *STREAM_KEY, "'2024-01-10T00:00:00.000000Z' as since", f"{_TEXT} as until",
            "5L as from_sequence", "cast(null as long) as to_sequence")).unionByName(base.where("stream = 'error'").selectExpr(
                "'empty' as selection_id", *STREAM_KEY, "'2030-01-01T00:00:00.000000Z' as since", f"{_TEXT} as until",
                "cast(null as long) as from_sequence", "cast(null as long) as to_sequence")).unionByName(
        base.where("stream = 'signup'").selectExpr(
            "'open_end' as selection_id", *STREAM_KEY, f"{_TEXT} as since", f"{_TEXT} as until", "20L as from_sequence",
            "cast(null as long) as to_sequence"))


_RANGES = """ranges AS (
  SELECT 'by_sequence' AS selection_id, 'click' AS stream, 61 AS first_sequence, 120 AS last_sequence, NULL AS error
  UNION ALL SELECT 'by_time', 'view', min(sequence), max(sequence), NULL FROM av WHERE stream = 'view'
    AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'
  UNION ALL SELECT 'both', 'error', NULL, NULL, 'times and sequences exclude one another'
  UNION ALL SELECT 'empty', 'error', NULL, NULL, 'the selection contains no events'
  UNION ALL SELECT 'open_end', 'signup', 20, max(sequence), NULL FROM av WHERE stream = 'signup')"""


@query("k08_select_ranges", WITH_AV + ", " + _RANGES + " SELECT * FROM ranges")
def k08(spark, sf):
    return evidence.select_ranges(_selections(spark, sf), data.chain(spark, sf), data.streams(spark, sf)).drop("tenant_id", "project_id")


def _rows(spark, sf):
    ranges = durable(evidence.select_ranges(_selections(spark, sf), data.chain(spark, sf), data.streams(spark, sf)))
    return evidence.export_rows(ranges, data.chain(spark, sf), data.checkpoints(spark, sf), {"actorId": "user_3"})


_EXPORT = CHAIN + ", " + _RANGES + """, sel AS (SELECT *, ((first_sequence - 1) // 50) * 50 AS anchor FROM ranges WHERE error IS NULL)"""


@query("k09_export_skeleton", _EXPORT + """ SELECT s.selection_id, c.sequence, c.event_hash FROM chain c JOIN sel s ON s.stream = c.stream
  AND c.sequence > s.anchor AND c.sequence <= s.last_sequence""")
def k09(spark, sf):
    return _rows(spark, sf)["chain"].select("selection_id", "sequence", "event_hash")


@query("k09_export_disclosed", _EXPORT + """ SELECT s.selection_id, c.sequence, c.content FROM chain c JOIN sel s ON s.stream = c.stream
  AND c.sequence BETWEEN s.first_sequence AND s.last_sequence WHERE c.actor_id = 'user_3'""")
def k09_disclosed(spark, sf):
    return _rows(spark, sf)["events"].select("selection_id", "sequence", "content")


@query("k09_export_checkpoints", _EXPORT + """ SELECT s.selection_id, c.sequence FROM chain c JOIN sel s ON s.stream = c.stream
  AND c.sequence % 50 = 0 AND c.sequence >= s.anchor AND c.sequence <= s.last_sequence""")
def k09_checkpoints(spark, sf):
    return _rows(spark, sf)["checkpoints"].select("selection_id", "sequence")


def _merge_inputs(spark, sf):
    """Skeletons of all streams and disclosures with errors by sequence modulo 50."""
    chain = data.chain(spark, sf).withColumn("line", F.col("sequence"))
    r = F.col("sequence") % 50
    skeleton = chain.where(r != 17).withColumn("content", F.lit(None).cast("string"))
    disclosed = chain.where(F.col("sequence") > 20) \
        .withColumn("recorded_at", F.when(r == 11, F.lit("2024-01-01T00:00:00.000000Z")).otherwise(F.col("recorded_at"))) \
        .withColumn("content", F.when(r == 13, F.lit(None).cast("string")).otherwise(F.col("content")))
    return skeleton, disclosed


_MERGE = WITH_AV + """, d AS (SELECT stream, sequence, CASE WHEN sequence % 50 = 17 THEN 'orphan' WHEN sequence % 50 = 11 THEN 'header'
  WHEN sequence % 50 = 13 THEN 'empty' WHEN sequence <= 30 THEN 'outside' END AS problem FROM av WHERE sequence > 20)"""


@query("c28_disclosure_mismatch", _MERGE + """ SELECT stream, sequence, 'disclosure_mismatch' AS code FROM d WHERE problem IN ('orphan', 'header', 'empty')""")
def c28(spark, sf):
    return _merge_findings(spark, sf).where("code = 'disclosure_mismatch'")


@query("c29_selection_mismatch", _MERGE + " SELECT stream, sequence, 'selection_mismatch' AS code FROM d WHERE problem = 'outside'")
def c29(spark, sf):
    return _merge_findings(spark, sf).where("code = 'selection_mismatch'")


def _merge_findings(spark, sf):
    merged = evidence.merge_disclosed(*_merge_inputs(spark, sf), STREAM_KEY, F.lit(31), F.lit(1 << 40))
    return merged.select("stream", evidence.disclosure_findings().alias("f")).where("f IS NOT NULL").select(
        "stream", "f.sequence", "f.code")


@query("j10_merge_disclosed", _MERGE + """ SELECT a.stream, a.sequence, a.sequence > 20 AND a.sequence % 50 <> 17 AS disclosed,
    CASE WHEN a.sequence > 20 AND d.problem IS NULL THEN a.content END AS content FROM av a LEFT JOIN d USING (stream, sequence)
    WHERE a.sequence % 50 <> 17 OR a.sequence > 20""")
def j10(spark, sf):
    merged = evidence.merge_disclosed(*_merge_inputs(spark, sf), STREAM_KEY, F.lit(31), F.lit(1 << 40))
    return merged.select("stream", "sequence", "disclosed", "content")


@query("j11_manifest_files", """SELECT path, code FROM (SELECT 'chain/part-' || c_custkey AS path, CASE c_custkey % 5
    WHEN 0 THEN 'package_digest_mismatch' WHEN 1 THEN 'package_digest_mismatch' WHEN 2 THEN 'package_digest_mismatch'
    WHEN 3 THEN 'package_malformed' END AS code FROM customer) WHERE code IS NOT NULL""")
def j11(spark, sf):
    # One file per customer: altered, missing, unlisted, listed twice, or fine.
    k = F.col("c_custkey")
    files = data.raw(spark, sf, "customer").select(
        k, F.concat(F.lit("chain/part-"), k.cast("string")).alias("path"), F.sha2("c_name", 256).alias("sha256"),
        F.length("c_name").cast("long").alias("size"))
    listed = files.where("c_custkey % 5 <> 2").unionByName(files.where("c_custkey % 5 = 3"))
    actual = files.where("c_custkey % 5 <> 1").withColumn("sha256", F.when(k % 5 == 0, F.reverse("sha256")).otherwise(F.col("sha256")))
    return evidence.file_findings(listed.drop("c_custkey"), actual.drop("c_custkey")).select("path", "code")


@query("c27_package_unanchored", """SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'genesis' WHEN 2 THEN 'missing' WHEN 3 THEN 'position'
    WHEN 4 THEN 'type' END AS problem FROM customer""")
def c27(spark, sf):
    k = F.col("c_custkey")
    rows = data.raw(spark, sf, "customer").select(
        k, F.when(k % 5 == 4, F.lit("other")).when(k % 5 <= 1, F.lit("genesis")).otherwise(F.lit("checkpoint")).alias("type"),
        F.when(k % 5 == 0, F.lit(1)).otherwise(F.lit(21)).cast("long").alias("first_sequence"), F.lit("chk").alias("checkpoint_id"),
        F.when(k % 5 == 3, F.lit(19)).when(k % 5 == 2, F.lit(None)).otherwise(F.lit(20)).cast("long").alias("checkpoint_sequence"))
    p = evidence.anchor_problem()
    return rows.select("c_custkey", F.when(p.contains("genesis"), F.lit("genesis")).when(p.contains("lacks the anchor"), F.lit("missing"))
                       .when(p.contains("is no anchor for"), F.lit("position")).when(p.contains("no kind of anchor"), F.lit("type")).alias("problem"))


def _dataset(spark, sf, filters) -> str:
    path = f"{checkpoint_root(spark)}/evidence-{uuid.uuid4().hex}"
    selection = _selections(spark, sf).where("selection_id = 'by_sequence'")
    evidence.export_evidence(
        spark, path, selection=selection, events=data.chain(spark, sf), streams=data.streams(spark, sf),
        checkpoints=data.checkpoints(spark, sf), keys=data.keys(spark),
        package=evidence.Package("exp_1", data.NOW, filters=filters), seeds=data.SEEDS, key_id=data.KEY["b"], undisclosed=True)
    return path


@query("k10_verify_evidence", WITH_AV + """ SELECT 'click' AS stream, 70 AS events_checked, count(*) AS payloads_checked, 51 AS first_sequence,
  120 AS last_sequence, 0 AS failure_count, 'valid' AS package, 2 AS checkpoints_verified FROM av
  WHERE stream = 'click' AND sequence BETWEEN 61 AND 120 AND actor_id = 'user_3'""", longs="events_checked first_sequence last_sequence failure_count checkpoints_verified")
def k10(spark, sf):
    # Export with a filter, then verify what was written, with pinned keys.
    path = _dataset(spark, sf, {"actorId": "user_3"})
    result = evidence.verify_evidence(spark, path, data.keys(spark))
    return result.verification.reports().select(
        F.col("ctx_stream").alias("stream"), "events_checked", "payloads_checked", "first_sequence", "last_sequence",
        "failure_count", "package", "checkpoints_verified")


@query("s12_read_evidence_files", """SELECT part, true AS listed FROM (VALUES ('chain'), ('checkpoints'), ('events'), ('public-keys')) t(part)
  WHERE (SELECT count(*) FROM events) > 0""")
def s12(spark, sf):
    path = _dataset(spark, sf, {})
    listed = spark.read.schema(evidence.MANIFEST_SCHEMA).json(f"{path}/manifest").select(F.explode("files").alias("e")).select("e.*")
    actual = evidence.digests(spark, path)
    both = actual.join(listed.select("path", F.col("sha256").alias("claimed")), "path").where("sha256 = claimed")
    return both.select(F.substring_index("path", "/", 1).alias("part")).distinct().withColumn("listed", F.lit(True))


# ---- files -----------------------------------------------------------------

def _place(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("s05_read_record_jsonl", CHAIN + " SELECT stream, sequence, event_id, event_hash, content FROM chain")
def s05(spark, sf):
    path = _place(spark, "records")
    data.chain(spark, sf).select(record_line(True).alias("value")).write.text(path)
    return read_record_jsonl(spark, path).where("error IS NULL").select("stream", "sequence", "event_id", "event_hash", "content")


@query("s05_bad_lines", WITH_AV + """, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE sequence % 10 = 1) AS bad,
  count(*) FILTER (WHERE sequence % 10 = 2) AS cut, count(*) FILTER (WHERE sequence % 10 = 3) AS blank FROM av)
  SELECT n - bad - cut - blank AS records, bad + cut AS errors FROM n""")
def s05_bad(spark, sf):
    # A repeated member, a cut line and a blank line in every ten.
    path = _place(spark, "bad-records")
    r = F.col("sequence") % 10
    line = record_line(False)
    broken = F.when(r == 1, F.concat(F.lit('{"stream":"x",'), F.substr(line, F.lit(2)))) \
        .when(r == 2, F.substring(line, 1, 40)).when(r == 3, F.lit("  ")).otherwise(line)
    data.chain(spark, sf).select(broken.alias("value")).write.text(path)
    return read_record_jsonl(spark, path).agg(F.count_if(F.col("error").isNull()).alias("records"),
                                              F.count_if(F.col("error").isNotNull()).alias("errors"))


@query("s06_read_keys", WITH_AV + " SELECT key_id, count(*) AS event_count FROM av GROUP BY key_id")
def s06(spark, sf):
    path = _place(spark, "keys")
    listed = data.keys(spark).agg(F.array_sort(F.collect_list(key_line())).alias("k"))      # keys of one project
    listed.select(F.concat(F.lit('{"keys":['), F.array_join("k", ","), F.lit("]}"))).write.text(path)
    return events_per_key(data.chain(spark, sf), read_keys(spark, path)).where("event_count > 0").select("key_id", "event_count")


@query("s07_read_witnesses", CHAIN + """ SELECT stream, max(sequence) AS sequence, max_by(event_hash, sequence) AS head_hash FROM chain
  WHERE stream = 'click' AND sequence % 50 = 0 GROUP BY stream""")
def s07(spark, sf):
    # The newest checkpoint of each stream, a file each; kept for one stream.
    path = _place(spark, "witnesses")
    newest = newest_per_key(data.checkpoints(spark, sf), STREAM_KEY, ["sequence"])
    newest.select(checkpoint_line().alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return read_witnesses(spark, path, "click").select("stream", "sequence", "head_hash")


@query("s11_write_evidence", WITH_AV + """ SELECT 'chain' AS part, 70 AS lines FROM av GROUP BY 1 UNION ALL SELECT 'checkpoints', 2 FROM av GROUP BY 1
  UNION ALL SELECT 'events', count(*) FROM av WHERE stream = 'click' AND sequence BETWEEN 61 AND 120 AND actor_id = 'user_3'""", longs="lines")
def s11(spark, sf):
    path = _dataset(spark, sf, {"actorId": "user_3"})
    parts = [spark.read.text(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("lines"))
             for p in ("chain", "checkpoints", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s13_anchor_checkpoints", WITH_AV + """ SELECT stream, sequence, 'anchored' AS first_status, 'failed' AS second_status FROM av WHERE sequence % 50 = 0""")
def s13(spark, sf):
    # Publishing twice: the second time every entry is there and stays as it is.
    path, cps = _place(spark, "anchors"), data.checkpoints(spark, sf)
    first = anchor_checkpoints(cps, path).select("checkpoint_id", F.col("status").alias("first_status"))
    second = anchor_checkpoints(cps, path).select("checkpoint_id", F.col("status").alias("second_status"))
    return cps.select("checkpoint_id", "stream", "sequence").join(first, "checkpoint_id").join(second, "checkpoint_id").drop("checkpoint_id")


@query("p33_manifest_hash", WITH_AV + f" SELECT event_id, {tagged(data.TAGS.manifest, 'content')} AS manifest_hash FROM av")
def p33(spark, sf):
    # The hash is over the canonical form, so it does not depend on how the document is written.
    text = F.concat(F.lit(" "), F.replace("content", F.lit(","), F.lit(" , ")))
    return data.submitted(spark, sf).select("event_id", evidence.manifest_hash(text, data.TAGS).alias("manifest_hash"))


@query("c24_package_malformed", """SELECT 'chain/part-' || c_custkey AS path, 'package_malformed' AS code FROM customer WHERE c_custkey % 5 = 3""")
def c24(spark, sf):
    return j11(spark, sf).where("code = 'package_malformed'")


@query("c25_package_digest_mismatch", """SELECT 'chain/part-' || c_custkey AS path, 'package_digest_mismatch' AS code FROM customer WHERE c_custkey % 5 < 3""")
def c25(spark, sf):
    return j11(spark, sf).where("code = 'package_digest_mismatch'")


@query("c26_manifest_signature_invalid", WITH_AV + f""" SELECT 'manifest_signature_invalid' AS code, 1 AS findings FROM av GROUP BY 1
  UNION ALL SELECT 'checkpoint_invalid', 2 FROM av GROUP BY 1
  UNION ALL SELECT 'unknown_signing_key', count(*) FROM av WHERE stream = 'click' AND sequence BETWEEN 51 AND 120 AND key_id = '{data.KEY["b"]}'
    HAVING count(*) > 0""", longs="findings")
def c26(spark, sf):
    # Verified by someone who trusts only the older key.
    path = _dataset(spark, sf, {})
    found = evidence.verify_evidence(spark, path, data.keys(spark).where(F.col("key_id") == data.KEY["a"])).findings()
    return found.where("severity = 'error'").groupBy("code").agg(F.count(F.lit(1)).alias("findings"))


# ---- many selections, whole streams, files -----------------------------------

def _many(spark, sf) -> DataFrame:
    """A selection per order: a window of time in a stream, from minutes to the whole time, many over one another."""
    n, names = F.col("o_orderkey"), data.streams(spark, sf).agg(F.array_sort(F.collect_list("stream")).alias("names"))   # five streams
    at = lambda c: F.date_format(F.timestamp_add("MINUTE", c.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = data.raw(spark, sf, "orders").select("o_orderkey").join(F.broadcast(names))
    start, width = n * 37 % 43200, F.when(n % 3 == 0, n % 50).when(n % 3 == 1, n % 2000).otherwise(n % 50000)
    return rows.select(n.cast("string").alias("selection_id"), F.lit(data.TENANT).alias("tenant_id"), F.lit(data.PROJECT).alias("project_id"),
                       F.when(n % 4 < 2, F.lit("click")).otherwise(F.element_at("names", (n % F.size("names") + 1).cast("int"))).alias("stream"),
                       F.when(n % 11 != 0, at(start)).alias("since"), at(start + width + 1).alias("until"),
                       F.lit(None).cast("long").alias("from_sequence"), F.lit(None).cast("long").alias("to_sequence"))


_MANY = WITH_AV + """, names AS (SELECT list(DISTINCT stream ORDER BY stream) AS names FROM av),
  raw_sel AS (SELECT o_orderkey AS n, names, o_orderkey * 37 % 43200 AS start, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 50 WHEN 1 THEN o_orderkey % 2000
    ELSE o_orderkey % 50000 END AS width FROM orders, names),
  many AS (SELECT n::VARCHAR AS selection_id, CASE WHEN n % 4 < 2 THEN 'click' ELSE names[n % len(names) + 1] END AS stream,
    CASE WHEN n % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(start::BIGINT) END AS since,
    TIMESTAMP '2024-01-01' + to_minutes((start + width + 1)::BIGINT) AS until FROM raw_sel),
  many_ranges AS (SELECT selection_id, m.stream, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM many m LEFT JOIN av a
    ON a.stream = m.stream AND (since IS NULL OR a.ts >= since) AND a.ts < until GROUP BY ALL)"""


@query("k08_many_time_selections", _MANY + """ SELECT selection_id, stream, first_sequence, last_sequence,
  CASE WHEN first_sequence IS NULL THEN 'the selection contains no events' END AS error FROM many_ranges""")
def k08_many(spark, sf):
    return evidence.select_ranges(_many(spark, sf), data.chain(spark, sf), data.streams(spark, sf)).drop("tenant_id", "project_id")


@query("k09_many_exports", _MANY + """ SELECT selection_id, count(*) AS chain_events, count(*) FILTER (WHERE sequence >= first_sequence) AS disclosed
  FROM (SELECT *, (first_sequence - 1) // 50 * 50 AS anchor FROM many_ranges WHERE first_sequence IS NOT NULL AND last_sequence - first_sequence < 500) s
  JOIN av a ON a.stream = s.stream AND a.sequence > anchor AND a.sequence <= last_sequence GROUP BY selection_id""")
def k09_many(spark, sf):
    """Events of every selection's segment, which starts behind its anchor; for windows of at most 500 sequences."""
    ranges = durable(evidence.select_ranges(_many(spark, sf), data.chain(spark, sf), data.streams(spark, sf)).where("last_sequence - first_sequence < 500"))
    rows = evidence.export_rows(ranges, data.chain(spark, sf), data.checkpoints(spark, sf), {})
    total = rows["chain"].groupBy("selection_id").agg(F.count(F.lit(1)).alias("chain_events"))
    return total.join(rows["events"].groupBy("selection_id").agg(F.count(F.lit(1)).alias("disclosed")), "selection_id")


def _at_once(job, items) -> list:
    """Jobs on small packages one beside the other; each alone leaves most cores idle."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(job, items))


def _whole_streams(spark, sf) -> dict[str, str]:
    """A dataset per stream with all its records; one package each, as a package is of one stream."""
    def make():
        streams, chain, checkpoints = data.streams(spark, sf), data.chain(spark, sf), data.checkpoints(spark, sf)

        def export(stream):
            path = f"{checkpoint_root(spark)}/evidence-{uuid.uuid4().hex}"
            selection = streams.where(F.col("stream") == stream).selectExpr(
                "'all' as selection_id", *STREAM_KEY, f"{_TEXT} as since", f"{_TEXT} as until", "1L as from_sequence", "cast(null as long) as to_sequence")
            evidence.export_evidence(
                spark, path, selection=selection, events=chain.where(F.col("stream") == stream), streams=streams, checkpoints=checkpoints,
                keys=data.keys(spark), package=evidence.Package("exp_" + stream, data.NOW), seeds=data.SEEDS, key_id=data.KEY["b"],
                compression="gzip")
            return stream, path
        return dict(_at_once(export, sorted(r.stream for r in streams.select("stream").collect())))
    return data.once(spark, sf, "whole_streams", make)


def _all(frames) -> DataFrame:
    from functools import reduce
    return reduce(DataFrame.unionByName, frames)


@query("k10_verify_whole_streams", WITH_AV + """ SELECT stream, count(*) AS events_checked, count(*) AS payloads_checked, 1 AS first_sequence, max(sequence) AS last_sequence,
  0 AS failure_count, 'valid' AS package, count(*) FILTER (WHERE sequence % 50 = 0) AS checkpoints_verified FROM av GROUP BY stream""", longs="first_sequence failure_count")
def k10_whole(spark, sf):
    paths, trusted = _whole_streams(spark, sf), data.keys(spark)
    return _all(_at_once(lambda path: durable(evidence.verify_evidence(spark, path, trusted).verification.reports().select(
        F.col("ctx_stream").alias("stream"), "events_checked", "payloads_checked", "first_sequence", "last_sequence",
        "failure_count", "package", "checkpoints_verified")), paths.values()))


@query("s11_write_whole_streams", CHAIN + """ SELECT stream, sequence, event_hash, content FROM chain""")
def s11_whole(spark, sf):
    return _all(read_record_jsonl(spark, f"{path}/events").where("error IS NULL").select("stream", "sequence", "event_hash", "content")
                for path in _whole_streams(spark, sf).values())


@query("s12_read_whole_streams", WITH_AV + """ SELECT stream, part, true AS equal FROM (SELECT DISTINCT stream FROM av),
  (VALUES ('chain'), ('checkpoints'), ('events'), ('public-keys')) t(part)""")
def s12_whole(spark, sf):
    """Every file of every package against its manifest entry."""
    def one(stream, path):
        listed = spark.read.schema(evidence.MANIFEST_SCHEMA).json(f"{path}/manifest").select(F.explode("files").alias("e")).select("e.*")
        both = listed.join(evidence.digests(spark, path).select("path", F.struct("sha256", "size").alias("found")), "path", "left")
        return both.groupBy(F.substring_index("path", "/", 1).alias("part")).agg(F.every(F.struct("sha256", "size").eqNullSafe(F.col("found"))).alias("equal")) \
            .select(F.lit(stream).alias("stream"), "part", "equal")
    return _all(one(stream, path) for stream, path in _whole_streams(spark, sf).items())


@query("s13_anchor_files", WITH_AV + """ SELECT stream, sequence, 1 AS anchored, 1 AS failed, 1 AS files FROM av WHERE sequence % 50 = 0""", longs="anchored failed files")
def s13_files(spark, sf):
    """Two runs at once over the same checkpoints: each is anchored by one of them, in one file."""
    from concurrent.futures import ThreadPoolExecutor

    from tracewright.sources.anchors import anchor_files
    path, cps = _place(spark, "anchor-files"), data.checkpoints(spark, sf)
    with ThreadPoolExecutor(2) as pool:
        runs = list(pool.map(lambda _: anchor_files(cps, path), range(2)))
    status = runs[0].unionByName(runs[1]).groupBy("checkpoint_id").agg(
        F.count_if(F.col("status") == "anchored").alias("anchored"), F.count_if(F.col("status") == "failed").alias("failed"))
    files = read_witnesses(spark, f"{path}/*/*/*/*.json", None).groupBy("checkpoint_id").agg(F.count(F.lit(1)).alias("files"))
    return cps.select("checkpoint_id", "stream", "sequence").join(status, "checkpoint_id").join(files, "checkpoint_id").drop("checkpoint_id")
