"""Evidence datasets: export a selection of a stream, re-verify it elsewhere.

A dataset is a directory:

    chain/         skeleton records without content, one JSON line each
    events/        disclosed records with content
    checkpoints/   signed checkpoints of the segment, the anchor among them
    public-keys/   keys of the project
    verification/  the report at export time
    manifest/      what was selected, and size and SHA-256 of every file
    signature/     signature over the canonical manifest
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.config import STORED, STREAM_PATTERN, ZERO_HASH, Tags, VerifyOptions
from tracewright.functions.canon import canonicalize, json_string
from tracewright.functions.crypto import base64_strict, base64_text, sign_hashes, verify_signatures
from tracewright.functions.hashing import tagged_hash
from tracewright.operators.checks import finding
from tracewright.operators.joins import bounded
from tracewright.operators.keys import split_keys
from tracewright.operators.ordered import with_previous
from tracewright.operators.ranges import extent_between, rows_between
from tracewright.plans.checkpointing import checkpoints_in_range, newest_at_or_before
from tracewright.plans.verify import Verification, _emit, verify_streams
from tracewright.schemas import CONTEXT_KEY, STREAM_KEY
from tracewright.session import durable
from tracewright.sources.readers import read_checkpoints, read_keys, read_record_jsonl
from tracewright.sources.sinks import checkpoint_line, key_line, record_line

FORMAT_VERSION = 1
PARTS = ["chain", "events", "checkpoints", "public-keys", "verification"]
BATCH_ROWS = 1000
#: Bytes read at a time for a digest, and the stores that tasks open by themselves.
DIGEST_BLOCK, TASK_STORES = 4 << 20, ("file", "hdfs", "s3", "gs")
_FILTERS = {"actorId": "actor_id", "action": "action", "resourceType": "resource_type", "resourceId": "resource_id"}
_SELECTION = ("fromSequence bigint, toSequence bigint, recordedFrom string, recordedTo string, "
              "filters map<string,string>, disclosedEvents bigint")
MANIFEST_SCHEMA = (
    "format string, formatVersion int, packageId string, createdAt string, generator struct<name:string,version:string>, "
    "tenant struct<id:string,name:string>, project struct<id:string,name:string>, stream string, "
    f"selection struct<{_SELECTION.replace(' bigint', ':bigint').replace(' string', ':string').replace(' map', ':map')}>, "
    "chain struct<firstSequence:bigint,lastSequence:bigint,events:bigint,"
    "anchor:struct<type:string,checkpointId:string,sequence:bigint,hash:string>,"
    "streamHeadAtExport:struct<sequence:bigint,hash:string>>, "
    "files array<struct<path:string,sha256:string,size:bigint>>, notice string")


@dataclass(frozen=True)
class Package:
    """Names that go into a manifest."""

    package_id: str
    created_at: str
    format: str = "evidence-dataset"
    generator: str = "tracewright"
    version: str = "1"
    notice: str = "Verify with independently obtained keys."
    filters: dict[str, str] = field(default_factory=dict)


def disclosure_filter(events: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Events whose content is disclosed: exact matches only, no prefixes."""
    for name, value in filters.items():
        events = events.where(F.col(_FILTERS[name]) == value)
    return events


# ---- selections ------------------------------------------------------------

def selection_errors() -> Column:
    """Why a selection row (stream, since, until, from_sequence, to_sequence) is refused, or null."""
    timed = F.col("since").isNotNull() | F.col("until").isNotNull()
    numbered = F.col("from_sequence").isNotNull() | F.col("to_sequence").isNotNull()
    return (F.when(~F.coalesce(F.col("stream").rlike(STREAM_PATTERN), F.lit(False)), F.lit("no stream is named"))
            .when(F.col("since") >= F.col("until"), F.lit("the time range is empty"))
            .when(timed & numbered, F.lit("times and sequences exclude one another"))
            .when(F.col("from_sequence") < 1, F.lit("sequences start at 1"))
            .when(F.col("to_sequence") < F.col("from_sequence"), F.lit("the sequence range is empty")))


def select_ranges(selections: DataFrame, events: DataFrame, streams: DataFrame) -> DataFrame:
    """Selections with first and last sequence, or an error.

    ``selections``: selection_id, stream key, since, until (canonical texts),
    from_sequence, to_sequence. Windows of time are answered from (stream,
    recorded_at, sequence) in one order with their borders, see `extent_between`.
    """
    checked = selections.withColumn("error", selection_errors()) \
        .join(streams.select(*STREAM_KEY, "head_sequence"), STREAM_KEY, "left")
    timed = checked.where("error IS NULL AND (since IS NOT NULL OR until IS NOT NULL)").select(
        "selection_id", *STREAM_KEY, "since", "until")
    spans = extent_between(events, timed, STREAM_KEY, "recorded_at", "sequence", "since", "until", "selection_id") \
        .withColumnsRenamed({"least": "_lo", "greatest": "_hi"})
    out = checked.join(spans, "selection_id", "left")
    by_time = F.col("since").isNotNull() | F.col("until").isNotNull()
    first = F.when(by_time, F.col("_lo")).otherwise(F.coalesce("from_sequence", F.lit(1)))
    last = F.when(by_time, F.col("_hi")).otherwise(F.least("to_sequence", "head_sequence"))
    empty = F.coalesce("head_sequence", F.lit(0)) == 0
    none = empty | first.isNull() | last.isNull() | (first > last)
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(none, F.lit("the selection contains no events"))
    return out.select("selection_id", *STREAM_KEY, F.when(error.isNull(), first.cast("long")).alias("first_sequence"),
                      F.when(error.isNull(), last.cast("long")).alias("last_sequence"), error.alias("error"))


def export_rows(ranges: DataFrame, events: DataFrame, checkpoints: DataFrame, filters: dict[str, str]) -> dict[str, DataFrame]:
    """Row sets of an export per selection: anchors, skeleton, disclosed, checkpoints."""
    usable = ranges.where("error IS NULL").withColumn("from_sequence", F.col("first_sequence")) \
        .withColumn("to_sequence", F.col("last_sequence"))
    # a row per selection, read by every row set
    anchors = durable(newest_at_or_before(usable.select("selection_id", *STREAM_KEY, "from_sequence", "to_sequence"), checkpoints))
    side = anchors.select("selection_id", *STREAM_KEY, "from_sequence", "to_sequence", "anchor_sequence")
    segment = rows_between(events, side, STREAM_KEY, "sequence", "anchor_sequence", "to_sequence")
    disclosed = disclosure_filter(segment.where(F.col("sequence") >= F.col("from_sequence")), filters)
    extra = ["from_sequence", "to_sequence", "anchor_sequence"]
    within = checkpoints_in_range(side, checkpoints).drop(*extra)
    own = anchors.where("anchor_type = 'checkpoint'").select("selection_id", F.col("anchor_checkpoint_id").alias("checkpoint_id"))
    anchor_rows = checkpoints.join(bounded(own), "checkpoint_id")
    return {"anchors": anchors, "chain": segment.drop(*extra).withColumn("content", F.lit(None).cast("string")),
            "events": disclosed.drop(*extra),
            "checkpoints": within.unionByName(anchor_rows)}


# ---- writing ---------------------------------------------------------------

def _write_lines(df: DataFrame, line: Column, path: str, order: list[str] | None = None, compression: str | None = None) -> None:
    """Lines in order over all files: range partitions become part files, named in order."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.select(line.alias("value")).write.mode("errorifexists")
    if compression:
        # hashes only lose their hexadecimal form, at any level
        writer = writer.option("compression", compression).option("zlib.compress.level", "BEST_SPEED")
    writer.text(path)


def _running_digests(batches):
    """Size and SHA-256 of files, read in blocks: a file of any size takes the memory of one block."""
    import hashlib
    from urllib.parse import unquote, urlsplit

    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        sums, sizes = [], []
        for uri in batch.column(0).to_pylist():
            local = uri.startswith("file:")
            store, own = (fs.LocalFileSystem(), unquote(urlsplit(uri).path)) if local else fs.FileSystem.from_uri(uri)
            running, size = hashlib.sha256(), 0
            with store.open_input_stream(own) as data:
                while block := data.read(DIGEST_BLOCK):
                    running.update(block)
                    size += len(block)
            sums.append(running.hexdigest())
            sizes.append(size)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sums, pa.string()), pa.array(sizes, pa.int64())], ["path", "sha256", "size"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path (relative), SHA-256 and size of every data file below a directory, empty ones too.

    The driver knows the files' names, tasks read them block by block. Stores
    that tasks cannot open by themselves are read by Spark, a file a row.
    """
    from urllib.parse import unquote, urlsplit
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    named = [(uri, unquote(urlsplit(uri).path).removeprefix(base)) for uri in raw.inputFiles()]
    shown = [(uri, name) for uri, name in named if not any(part.startswith((".", "_")) for part in name.split("/"))]
    files = spark.createDataFrame(shown, "uri string, path string")
    if fs.getScheme() in TASK_STORES:
        dealt = files.repartition(max(1, min(len(shown), spark.sparkContext.defaultParallelism * 8)), "uri")
        return dealt.mapInArrow(_running_digests, "path string, sha256 string, size long")
    found = raw.select(F.expr(f"substring_index(path, '{base}', -1)").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    return files.select("path").join(found, "path", "left").select(                      # Spark has no row for an empty file
        "path", F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("sha256"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def manifest_hash(manifest: Column, tags: Tags) -> Column:
    return tagged_hash(tags.manifest, canonicalize(manifest, STORED)["canonical"])


def export_evidence(spark: SparkSession, path: str, *, selection: DataFrame, events: DataFrame, streams: DataFrame,
                    checkpoints: DataFrame, keys: DataFrame, package: Package, seeds: dict[str, bytes], key_id: str,
                    report: DataFrame | None = None, tags: Tags = Tags(), undisclosed: bool = False,
                    compression: str | None = None) -> None:
    """Write one selection (one row) as an evidence dataset.

    Filters that leave no event to disclose are refused, unless ``undisclosed``
    asks for the chain alone: then the package shows that the events exist, and none of them.
    ``compression`` ("gzip") is that of the record lines, the bulk of a package; the manifest names the files as they are stored.
    """
    ranges = durable(select_ranges(selection, events, streams))
    refused = ranges.where("error IS NOT NULL").first()
    if refused:
        raise ValueError(refused["error"])
    rows = export_rows(ranges, events, checkpoints, package.filters)
    disclosed = rows["events"]
    if not undisclosed and disclosed.isEmpty():
        raise ValueError("the selection contains no events")
    _write_lines(rows["chain"], record_line(False), f"{path}/chain", ["sequence"], compression)
    _write_lines(disclosed, record_line(True), f"{path}/events", ["sequence"], compression)
    _write_lines(rows["checkpoints"], checkpoint_line(), f"{path}/checkpoints", ["sequence"])
    listed = keys.agg(F.array_sort(F.collect_list(key_line())).alias("k"))       # keys of one project
    _write_lines(listed, F.concat(F.lit('{"keys":['), F.array_join("k", ","), F.lit("]}")), f"{path}/public-keys")
    if report is not None:
        report.write.mode("errorifexists").json(f"{path}/verification")

    files = digests(spark, path).agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "size"))).alias("files"))
    anchor = rows["anchors"]
    chain = spark.read.text(f"{path}/chain").agg(F.count(F.lit(1)).alias("chain_events"))
    shown = spark.read.text(f"{path}/events").agg(F.count(F.lit(1)).alias("disclosed"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731 - one-row tables side by side
    facts = one(anchor).join(one(files), "_one").join(one(chain), "_one").join(one(shown), "_one") \
        .join(streams.select(*STREAM_KEY, "head_sequence", "head_hash"), STREAM_KEY) \
        .join(selection.select("selection_id", "since", "until"), "selection_id")
    entry = lambda f: F.concat(F.lit('{"path":'), json_string(f["path"]), F.lit(',"sha256":"'), f["sha256"],
                               F.lit('","size":'), f["size"].cast("string"), F.lit("}"))
    filters = "{" + ",".join(f'"{k}":{{}}' for k in sorted(package.filters)) + "}"
    filter_text = F.format_string(filters.replace("{}", "%s"), *[json_string(F.lit(package.filters[k])) for k in sorted(package.filters)]) \
        if package.filters else F.lit("{}")
    text = lambda v: json_string(F.lit(v) if isinstance(v, str) else v)
    optional = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{name}":'), text(F.col(c)), F.lit(",")))
    number = lambda c: F.col(c).cast("string")
    manifest = F.concat(
        F.lit('{"format":'), text(package.format), F.lit(f',"formatVersion":{FORMAT_VERSION},"packageId":'), text(package.package_id),
        F.lit(',"createdAt":'), text(package.created_at), F.lit(',"generator":{"name":'), text(package.generator),
        F.lit(',"version":'), text(package.version), F.lit('},"tenant":{"id":'), text(F.col("tenant_id")),
        F.lit('},"project":{"id":'), text(F.col("project_id")), F.lit('},"stream":'), text(F.col("stream")),
        F.lit(',"selection":{"fromSequence":'), number("from_sequence"), F.lit(',"toSequence":'), number("to_sequence"), F.lit(","),
        F.coalesce(optional("recordedFrom", "since"), F.lit("")), F.coalesce(optional("recordedTo", "until"), F.lit("")),
        F.lit('"filters":'), filter_text, F.lit(',"disclosedEvents":'), number("disclosed"),
        F.lit('},"chain":{"firstSequence":'), (F.col("anchor_sequence") + 1).cast("string"), F.lit(',"lastSequence":'),
        number("to_sequence"), F.lit(',"events":'), number("chain_events"), F.lit(',"anchor":{"type":'), text(F.col("anchor_type")),
        F.coalesce(F.concat(F.lit(',"checkpointId":'), text(F.col("anchor_checkpoint_id"))), F.lit("")),
        F.lit(',"sequence":'), number("anchor_sequence"), F.lit(',"hash":'), text(F.col("anchor_hash")),
        F.lit('},"streamHeadAtExport":{"sequence":'), number("head_sequence"), F.lit(',"hash":'), text(F.col("head_hash")),
        F.lit('}},"files":['), F.array_join(F.transform("files", entry), ","), F.lit('],"notice":'), text(package.notice), F.lit("}"))
    document = durable(facts.select(manifest.alias("value")))
    document.write.mode("errorifexists").text(f"{path}/manifest")
    signed = document.withColumn("hash", manifest_hash(F.col("value"), tags)).withColumn("key_id", F.lit(key_id)) \
        .withColumn("mark", sign_hashes(F.col("hash"), F.col("key_id"), seeds, tags.manifest_signature))
    _write_lines(signed, F.concat(F.lit('{"keyId":"'), F.col("key_id"), F.lit('","algorithm":"Ed25519","manifestHash":"'),
                                  F.col("hash"), F.lit('","signature":"'), base64_text("mark"), F.lit('"}')), f"{path}/signature")


# ---- verifying -------------------------------------------------------------

def file_findings(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest entries against files: listed twice, missing, altered, unlisted. Columns code, path, expected, found."""
    own = F.col("path").rlike(r"^(manifest|signature)(/|\z)")
    entries = listed.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("sha256", "size")).alias("_l"))
    both = entries.join(actual.select("path", F.struct("sha256", "size").alias("_a")), "path", "full_outer")
    malformed = F.col("_n").isNotNull() & ((F.col("_n") > 1) | own)
    code = (F.when(malformed, F.lit("package_malformed"))
            .when(F.col("_a").isNull() | (F.col("_n").isNull() & ~own), F.lit("package_digest_mismatch"))
            .when(F.col("_n").isNotNull() & (F.col("_l") != F.col("_a")), F.lit("package_digest_mismatch")))
    why = (F.when(malformed, F.lit("has several entries, or one that no manifest may have"))
           .when(F.col("_a").isNull(), F.lit("has an entry, but there is no such file"))
           .when(F.col("_n").isNull(), F.lit("has no entry"))
           .otherwise(F.lit("differs from its entry")))
    return both.select("path", code.alias("code"), F.concat_ws(" ", "path", why).alias("message"),
                       F.col("_l.sha256").alias("expected"), F.col("_a.sha256").alias("found")).where("code IS NOT NULL")


def anchor_problem() -> Column:
    """Why the manifest's anchor does not hold, or null. Needs type, first_sequence, checkpoint_id, checkpoint_sequence."""
    genesis = F.col("type") == "genesis"
    first = F.col("first_sequence")
    return (F.when(~F.coalesce(F.col("type").isin("genesis", "checkpoint"), F.lit(False)),
                   F.concat(F.lit("no kind of anchor: "), F.coalesce("type", F.lit(""))))
            .when(genesis & (first != 1), F.format_string("a chain from genesis cannot start at sequence %d", first))
            .when(~genesis & F.col("checkpoint_sequence").isNull(), F.concat(
                F.lit("the package lacks the anchor, checkpoint "), F.coalesce("checkpoint_id", F.lit(""))))
            .when(~genesis & (F.col("checkpoint_sequence") != first - 1), F.format_string(
                "checkpoint %s at %d is no anchor for a start at %d", F.col("checkpoint_id"),
                F.col("checkpoint_sequence"), first)))


_HEADER = ["schema_version", "tenant_id", "project_id", "stream", "event_id", "recorded_at", "previous_hash",
           "payload_hash", "key_id", "event_hash", "signature"]


def merge_disclosed(skeleton: DataFrame, disclosed: DataFrame, keys: list[str], first: Column, last: Column) -> DataFrame:
    """Skeleton and disclosed records by sequence: full outer, one row per record.

    Both carry a ``line`` ordinal. The first skeleton record of a sequence takes
    the first disclosed one; every other disclosed record is left over.
    ``disclosure`` says what is wrong with the pair, or null.
    """
    def first_of(df: DataFrame) -> DataFrame:
        least = df.groupBy(*keys, "sequence").agg(F.min("line").alias("_line"))
        return df.join(least, [*keys, "sequence"]).withColumn("_first", F.col("line") == F.col("_line")).drop("_line")

    shown = first_of(disclosed).select(*keys, "sequence", F.struct(*_HEADER).alias("_d"), F.col("content").alias("_content"),
                                       F.col("line").alias("disclosed_line"), F.col("_first").alias("_take"))
    base = first_of(skeleton).withColumn("_take", F.col("_first")).withColumn("_s", F.struct(*_HEADER)).drop("_first")
    both = base.join(shown, [*keys, "sequence", "_take"], "full_outer")
    there, given = F.col("line").isNotNull(), F.col("disclosed_line").isNotNull()
    problem = (F.when(given & ~there, F.lit("orphan"))
               .when(given & ~F.col("_s").eqNullSafe(F.col("_d")), F.lit("header"))
               .when(given & (F.coalesce(F.length("_content"), F.lit(0)) == 0), F.lit("empty"))
               .when(given & ~F.col("sequence").between(first, last), F.lit("outside")))
    used = given & there & problem.isNull()
    return both.withColumn("disclosure", problem).withColumn("skeleton_content", F.col("content")) \
        .withColumn("content", F.when(used, F.col("_content"))) \
        .withColumn("event_id", F.coalesce("event_id", "_d.event_id")) \
        .withColumn("disclosed", given & there).drop("_s", "_d", "_content", "_take")


def disclosure_findings() -> Column:
    """Finding of a merged row."""
    p = F.col("disclosure")
    return F.coalesce(
        finding("disclosure_mismatch", p == "orphan", 1, "content is shown for a record that the chain lacks"),
        finding("disclosure_mismatch", p == "header", 1, "shown header and chain header differ"),
        finding("disclosure_mismatch", p == "empty", 1, "a shown record is empty"),
        finding("selection_mismatch", p == "outside", 1, "a record is shown that was not selected"))


def selection_findings(manifest: DataFrame, totals: DataFrame, names: list[str]) -> DataFrame:
    """Counts and ends of the package against its manifest (one row each, joined on the chain)."""
    both = manifest.join(totals, names, "left")
    m_events, m_first, m_last = F.col("chain.events"), F.col("chain.firstSequence"), F.col("chain.lastSequence")
    some = F.coalesce("chain_count", F.lit(0)) > 0
    size = F.col("selection.toSequence") - F.col("selection.fromSequence") + 1
    count = F.coalesce("chain_count", F.lit(0))
    shown = F.coalesce("disclosed_count", F.lit(0))
    no_filter = F.coalesce(F.size("selection.filters"), F.lit(0)) <= 0
    zero = {"sequence": F.lit(0), "event_id": None}
    checks = [
        finding("selection_mismatch", (count != m_events) | (some & (
            (F.col("first_line_sequence") != m_first) | (F.col("last_line_sequence") != m_last))), 1,
            "manifest and chain lines give different extents",
            F.format_string("%d events, sequences %d..%d", m_events, m_first, m_last),
            F.format_string("%d events, sequences %d..%d", count, F.coalesce("first_line_sequence", F.lit(0)),
                            F.coalesce("last_line_sequence", F.lit(0))), **zero),
        finding("selection_mismatch", shown != F.col("selection.disclosedEvents"), 2,
                "manifest and shown records differ in number",
                F.col("selection.disclosedEvents"), shown, **zero),
        finding("selection_mismatch", no_filter & (F.col("selection.disclosedEvents") != size), 3,
                "nothing is filtered, yet not all of the range is shown", size,
                F.col("selection.disclosedEvents"), **zero),
        finding("selection_mismatch", some & (F.col("last_line_sequence") != F.col("selection.toSequence")), 4,
                F.format_string("last record %d, end of the selection %d", F.col("last_line_sequence"),
                                F.col("selection.toSequence")), **zero),
    ]
    return both.select(*names, F.explode(F.array_compact(F.array(*checks))).alias("f"))


def _at(df: DataFrame, names: list[str], phase: int, batch: Column, ordinal: Column, rank: Column) -> DataFrame:
    return df.select(*names, *[f"f.{c}" for c in ("code", "severity", "sequence", "event_id", "message", "expected", "found")],
                     F.struct(F.lit(phase).alias("phase"), batch.cast("long").alias("batch"), F.lit(0).alias("sub"),
                              ordinal.cast("long").alias("ordinal"), rank.cast("int").alias("rank")).alias("emission"))


@dataclass
class EvidenceResult:
    """``stopped`` findings end the check before the chain; otherwise ``verification`` holds all findings."""

    manifest: DataFrame
    stopped: DataFrame | None
    verification: Verification | None

    def findings(self) -> DataFrame:
        return self.stopped if self.verification is None else self.verification.findings()


def verify_evidence(spark: SparkSession, path: str, trusted_keys: DataFrame | None = None, *, format: str = "evidence-dataset",
                    tags: Tags = Tags(), clock_skew_seconds: int = 300) -> EvidenceResult:
    """Check files, manifest, signature, anchor, disclosure and the chain of a dataset."""
    raw = durable(spark.read.text(f"{path}/manifest", wholetext=True).select(F.trim("value", F.lit(" \n")).alias("text"))
                  .withColumn("c", canonicalize(F.col("text"), STORED)).withColumn("m", F.from_json("text", MANIFEST_SCHEMA)))
    manifest = raw.select(F.col("m.tenant.id").alias("ctx_tenant_id"), F.col("m.project.id").alias("ctx_project_id"),
                          F.col("m.stream").alias("ctx_stream"), "m.*", "text", F.col("c.error").alias("json_error"))
    names = CONTEXT_KEY
    whole = {"sequence": F.lit(0), "event_id": None}

    def early(df: DataFrame, found: Column, rank: int) -> DataFrame:
        return _emit(df, names, 3, found, F.lit(0), F.lit(rank))

    shape = early(manifest, F.coalesce(
        finding("package_malformed", F.col("json_error").isNotNull(), 0, F.concat(F.lit("the manifest is not valid JSON: "), F.col("json_error")), **whole),
        finding("package_malformed", ~F.col("format").eqNullSafe(format) | ~F.col("formatVersion").eqNullSafe(FORMAT_VERSION), 0,
                F.concat(F.lit("unsupported package format "), F.coalesce("format", F.lit(""))), **whole)), 0)
    listed = manifest.select(F.explode("files").alias("e")).select("e.*")
    context = manifest.select(*names)
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731 - the manifest is one row
    differing = one(file_findings(listed, digests(spark, path))).join(F.broadcast(one(context)), "_one")
    bad_files = early(differing, F.when(F.lit(True), F.struct(
        "code", F.lit("error").alias("severity"), F.lit(0).cast("long").alias("sequence"), F.lit(None).cast("string").alias("event_id"),
        "message", "expected", "found", F.lit(1).alias("rank"))), 1)
    fatal = durable(shape.unionByName(bad_files))
    if not fatal.isEmpty():
        return EvidenceResult(manifest, fatal, None)

    embedded = read_keys(spark, f"{path}/public-keys")
    trusted, rejected = split_keys(embedded if trusted_keys is None else trusted_keys, [])
    if trusted_keys is not None:
        rejected = rejected.where("false")
    cps = read_checkpoints(spark, f"{path}/checkpoints", lines=True)
    anchor = F.col("chain.anchor")
    placed = durable(manifest.select(
        *names, anchor["type"].alias("type"), F.col("chain.firstSequence").alias("first_sequence"),
        anchor["checkpointId"].alias("checkpoint_id")).join(
        cps.select("checkpoint_id", F.col("sequence").alias("checkpoint_sequence"), F.col("head_hash").alias("checkpoint_head")),
        "checkpoint_id", "left"))
    unanchored = durable(early(placed, finding("package_unanchored", anchor_problem().isNotNull(), 0, anchor_problem(), **whole), 3))
    signature = one(spark.read.schema("keyId string, algorithm string, manifestHash string, signature string")
                    .json(f"{path}/signature")).join(one(manifest), "_one") \
        .withColumn("actual", manifest_hash(F.col("text"), tags)) \
        .join(bounded(trusted.select(F.col("key_id").alias("keyId"), "public_key")), "keyId", "left") \
        .withColumn("ok", verify_signatures(F.col("actual"), F.col("public_key"), base64_strict(F.col("signature")),
                                            tags.manifest_signature))
    bad_signature = early(signature, F.coalesce(
        finding("manifest_signature_invalid", F.col("actual") != F.col("manifestHash"), 0,
                "the manifest was modified after it was signed", F.col("manifestHash"), F.col("actual"), **whole),
        finding("manifest_signature_invalid", F.col("public_key").isNull(), 0,
                F.concat(F.lit("the manifest is signed by key "), F.col("keyId"), F.lit(", which is not trusted")), **whole),
        finding("manifest_signature_invalid", ~F.col("ok") | (F.col("algorithm") != "Ed25519"), 0,
                F.concat(F.lit("the manifest signature does not verify under key "), F.col("keyId")), **whole)), 2)
    if not unanchored.isEmpty():
        return EvidenceResult(manifest, bad_signature.unionByName(unanchored), None)

    skeleton_lines = durable(read_record_jsonl(spark, f"{path}/chain").withColumn("line", F.col("ordinal")).drop("ordinal"))
    disclosed_lines = durable(read_record_jsonl(spark, f"{path}/events").withColumn("line", F.col("ordinal")).drop("ordinal"))
    limits = F.broadcast(one(manifest.select(*names, F.col("selection.fromSequence").alias("_from"),
                                             F.col("selection.toSequence").alias("_to"), F.col("chain.firstSequence").alias("_begin"))))
    skeleton = one(skeleton_lines.where("error IS NULL")).join(limits, "_one").drop("_one")
    disclosed = one(disclosed_lines.where("error IS NULL")).join(limits.select("_one", *names), "_one").drop("_one")
    merged = durable(merge_disclosed(skeleton, disclosed, names, F.col("_from"), F.col("_to")))
    spot = F.coalesce("line", F.col("sequence") - F.coalesce("_begin", F.lit(1)) + 1)
    batch = F.floor((F.greatest(spot, F.lit(1)) - 1) / F.lit(BATCH_ROWS))
    own = merged.withColumn("f", F.explode(F.array_compact(F.array(
        finding("package_malformed", F.coalesce(F.length("skeleton_content") > 0, F.lit(False)), 0,
                "the chain skeleton must not contain event content"), disclosure_findings()))))
    package = _at(own, names, 4, batch, spot, F.col("f.rank"))
    unordered = with_previous(disclosed, disclosed, names, ["line"], ["sequence"]).where("sequence <= prev_sequence")
    package = package.unionByName(_at(unordered.withColumn("f", finding(
        "package_malformed", F.lit(True), 2, "the event lines are not in ascending sequence order", event_id=None)),
        names, 4, F.floor((F.col("line") - 1) / F.lit(BATCH_ROWS)), F.col("line"), F.lit(2)))
    for part, lines in (("chain", skeleton_lines), ("events", disclosed_lines)):
        broken = one(lines.where("error IS NOT NULL")).join(F.broadcast(one(context)), "_one")
        package = package.unionByName(_at(broken.withColumn("f", finding(
            "package_malformed", F.lit(True), 3, F.concat(F.lit(part + " "), F.col("error")), sequence=F.lit(0), event_id=None)),
            names, 4, F.floor((F.col("line") - 1) / F.lit(BATCH_ROWS)), F.col("line"), F.lit(3)))
    totals = merged.where("line IS NOT NULL").groupBy(*names).agg(
        F.count(F.lit(1)).alias("chain_count"), F.min_by("sequence", "line").alias("first_line_sequence"),
        F.max_by("sequence", "line").alias("last_line_sequence"), F.count_if("disclosed").alias("disclosed_count"))
    package = package.unionByName(_at(selection_findings(manifest, totals, names), names, 4, F.lit((1 << 62)), F.lit(0), F.col("f.rank")))
    package = package.unionByName(bad_signature)

    start = placed.select(*names, F.coalesce("checkpoint_sequence", F.lit(0)).cast("long").alias("anchor_sequence"),
                          F.coalesce("checkpoint_head", F.lit(ZERO_HASH)).alias("anchor_hash"), F.when(
        F.col("checkpoint_sequence").isNull(), F.lit("genesis")).otherwise(F.format_string(
            "checkpoint %s (sequence %d)", F.col("checkpoint_id"), F.col("checkpoint_sequence"))).alias("anchor_description"))
    options = VerifyOptions(tags=tags, require_content=False, require_canonical=False, check_index=False, order_col="line",
                            batch_rows=BATCH_ROWS, clock_skew_seconds=clock_skew_seconds)
    records = merged.where("line IS NOT NULL")
    # Checkpoints are judged in the package's context, whatever stream they name.
    in_context = one(cps).join(F.broadcast(one(context)), "_one").drop("_one")
    result = verify_streams(records, embedded, checkpoints=in_context, anchors=start, options=options, pinned=True,
                            trusted=(trusted, rejected))
    result.extra = package
    return EvidenceResult(manifest, None, result)
