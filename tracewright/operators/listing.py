"""Reads, filters, pages and views of events, streams and runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.crypto import base64_text
from tracewright.functions.times import window_bound
from tracewright.operators.joins import lookup_join
from tracewright.operators.ordered import newest_per_key
from tracewright.schemas import HEADER_COLUMNS, STREAM_KEY
from tracewright.session import written

_ANY_JSON = "string"
#: Rows of a page at most.
MAX_PAGE = 500
#: Tenant and project; every read is for one.
Scope = tuple[str, str]


def of_tenant(df: DataFrame, tenant_id: str, project_id: str) -> DataFrame:
    """Every read goes through this: rows of one project only."""
    return df.where((F.col("tenant_id") == tenant_id) & (F.col("project_id") == project_id))


def within(limit: int, most: int) -> int:
    """The limit, if it is one; anything else is the caller's mistake, not a reason to answer another question."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}, not {limit}")
    return limit


def chain_page(events: DataFrame, scope: Scope, stream: str, after: int, limit: int) -> DataFrame:
    return of_tenant(events, *scope).where((F.col("stream") == stream) & (F.col("sequence") > after)).orderBy("sequence").limit(limit)


def chain_range(events: DataFrame, scope: Scope, stream: str, first: int, last: int) -> DataFrame:
    return of_tenant(events, *scope).where((F.col("stream") == stream) & F.col("sequence").between(first, last))


def events_by_ids(events: DataFrame, scope: Scope, ids: DataFrame) -> DataFrame:
    """``ids``: one row with an array event_ids. Missing ids are skipped; position keeps the list's order."""
    wanted = ids.select(F.posexplode("event_ids").alias("position", "event_id"))
    return lookup_join(of_tenant(events, *scope), wanted, ["event_id"], "inner").orderBy("position")


def neighbours(events: DataFrame) -> DataFrame:
    """Stream key, sequence, and the ids of the records numbered one less and one more, null where there is none.

    Joined by number, not by order: a neighbour may be missing.
    """
    rows = events.select(*STREAM_KEY, "sequence", "event_id")
    place = [*STREAM_KEY, "sequence"]

    def beside(step: int, name: str) -> DataFrame:
        return rows.select(*STREAM_KEY, (F.col("sequence") - step).alias("sequence"), F.col("event_id").alias(name))

    return rows.drop("event_id").join(beside(-1, "before_id"), place, "left").join(beside(1, "after_id"), place, "left")


def stream_names(events: DataFrame, scope: Scope) -> DataFrame:
    """The names of a project's streams in order; duplicates go before the shuffle."""
    return of_tenant(events, *scope).select("stream").distinct().orderBy("stream")


def filter_events(events: DataFrame, scope: Scope, *, stream: str = "", actor_id: str = "", actor_type: str = "", action: str = "",
                  resource_type: str = "", resource_id: str = "", since: str | None = None,
                  until: str | None = None) -> DataFrame:
    """Optional equality filters, action prefix (trailing *) and a half-open time window."""
    out = of_tenant(events, *scope)
    for name, value in (("stream", stream), ("actor_id", actor_id), ("actor_type", actor_type),
                        ("resource_type", resource_type), ("resource_id", resource_id)):
        if value:
            out = out.where(F.col(name) == value)
    if action:
        out = out.where(F.col("action").startswith(action[:-1]) if action.endswith("*") else F.col("action") == action)
    if since:
        out = out.where(F.col("recorded_at") >= window_bound(F.lit(since)))
    if until:
        out = out.where(F.col("recorded_at") < window_bound(F.lit(until)))
    return out


def before_cursor(events: DataFrame, scope: Scope, recorded_at: str, event_id: str) -> DataFrame:
    """Events strictly older than a position of the newest-first order."""
    return of_tenant(events, *scope).where((F.col("recorded_at") < recorded_at)
                        | ((F.col("recorded_at") == recorded_at) & (F.col("event_id") < event_id)))


def newest_first(events: DataFrame, scope: Scope, limit: int = 50) -> DataFrame:
    return of_tenant(events, *scope).orderBy(F.desc("recorded_at"), F.desc("event_id")).limit(within(limit, MAX_PAGE + 1))


def page_with_cursor(events: DataFrame, scope: Scope, limit: int = 50) -> DataFrame:
    """A page plus has_more and, on its last row, the next cursor: one row of look-ahead."""
    ahead = newest_first(events, scope, within(limit, MAX_PAGE) + 1)
    place = Window.orderBy(F.desc("recorded_at"), F.desc("event_id"))    # at most limit + 1 rows
    numbered = ahead.withColumn("position", F.row_number().over(place).cast("long")) \
        .withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    last = F.col("has_more") & (F.col("position") == limit)
    return numbered.where(F.col("position") <= limit) \
        .withColumn("next_cursor", F.when(last, F.concat_ws("|", "recorded_at", "event_id")))


def page_numbers(events: DataFrame, scope: Scope, size: int, slice_rows: int = 1_000_000) -> DataFrame:
    """All pages of the newest-first listing in one ordered scan.

    A total order over everything: Spark deals the rows into ranges of this very
    order, of about ``slice_rows`` rows each, which are written once, counted,
    and numbered inside - no single task sorts them all.
    """
    from tracewright.operators.ordered import number_rows
    own, order = of_tenant(events, *scope), [F.desc("recorded_at"), F.desc("event_id")]
    slices = max(1, -(-own.count() // slice_rows))
    dealt = own.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id().cast("long"))
    rows = written(dealt.withColumn("_all", F.lit(1)), "page-slices")
    numbered = number_rows(rows, ["_all"], order, F.col("_slice"), "position").drop("_slice")
    return numbered.withColumn("page", F.floor((F.col("position") - 1) / F.lit(size)).cast("long") + 1).drop("_all", "_age")


def latest_verifications(results: DataFrame) -> DataFrame:
    """The newest result of each stream."""
    return newest_per_key(results, STREAM_KEY, ["completed_at", "run_id"])


def event_status(sequence: Column, last: Column, first_failure: Column) -> Column:
    """verified | failed | unverified from the stream's newest verification."""
    return (F.when(last.isNull() | (sequence > last), F.lit("unverified"))
            .when(first_failure.isNotNull() & (sequence >= first_failure), F.lit("failed"))
            .otherwise(F.lit("verified")))


def with_status(events: DataFrame, results: DataFrame) -> DataFrame:
    latest = latest_verifications(results).select(
        *STREAM_KEY, F.col("last_sequence").alias("_last"), F.col("first_failure_sequence").alias("_first"),
        F.col("run_id"), F.col("completed_at").alias("verified_at"))
    out = lookup_join(events, latest, STREAM_KEY).withColumn(
        "status", event_status(F.col("sequence"), F.col("_last"), F.col("_first")))
    seen = F.col("status") != "unverified"
    return out.withColumn("run_id", F.when(seen, F.col("run_id"))) \
        .withColumn("verified_at", F.when(seen, F.col("verified_at"))).drop("_last", "_first")


def stream_status(valid: Column) -> Column:
    return F.when(valid.isNull(), F.lit("never")).when(valid, F.lit("passed")).otherwise(F.lit("failed"))


def list_streams(streams: DataFrame, results: DataFrame, scope: Scope) -> DataFrame:
    latest = latest_verifications(results).select(*STREAM_KEY, "run_id", "valid", "last_sequence", "failure_count",
                                                  "first_failure_sequence", F.col("completed_at").alias("verified_at"))
    return of_tenant(streams, *scope).join(latest, STREAM_KEY, "left").withColumn("status", stream_status(F.col("valid"))).orderBy("stream")


def render_event(events: DataFrame) -> DataFrame:
    """Public view: everything comes from the signed content, nothing from index columns."""
    view = F.from_json("content", f"""action string, actor struct<type:string,id:string,displayName:string>,
        resource struct<type:string,id:string,displayName:string>, before {_ANY_JSON}, after {_ANY_JSON},
        changes {_ANY_JSON}, data {_ANY_JSON}, metadata {_ANY_JSON}, context {_ANY_JSON}, occurredAt string,
        redactions array<string>""")
    rest = [c for c in ("status", "run_id", "verified_at", "position", "page", "has_more", "next_cursor") if c in events.columns]
    return events.withColumn("_view", view).select(
        "event_id", "stream", "sequence", "recorded_at", "_view.*", "schema_version", "previous_hash", "payload_hash",
        "event_hash", base64_text("signature").alias("signature"), "key_id", F.lit("Ed25519").alias("algorithm"), *rest)


def receipts(events: DataFrame) -> DataFrame:
    return events.select("event_id", "stream", "sequence", "recorded_at", "payload_hash", "previous_hash", "event_hash",
                         base64_text("signature").alias("signature"), "key_id")


def chain_records(events: DataFrame, streams: DataFrame, with_content: bool = True) -> DataFrame:
    """Raw records with the stream's head and the position to continue from."""
    rows = events.select(*HEADER_COLUMNS, "event_hash", "signature", *(["content"] if with_content else []))
    heads = streams.select(*STREAM_KEY, "head_sequence", "head_hash")
    out = lookup_join(rows, heads, STREAM_KEY)
    return out.withColumn("next_after", F.when(F.col("sequence") < F.col("head_sequence"), F.col("sequence")))


def without_content(events: DataFrame) -> DataFrame:
    return events.withColumn("content", F.lit(None).cast("string"))


def streams_needing_checkpoint(streams: DataFrame, min_events: int, max_age_seconds: int, now: str) -> DataFrame:
    """All streams far enough behind, or with new events older than the age limit; most behind first."""
    from tracewright.functions.times import format_time
    behind = F.col("head_sequence") - F.col("last_checkpoint_sequence")
    moment = F.substring(F.lit(now), 1, 26).cast("timestamp_ntz")
    oldest = format_time(moment - F.expr(f"INTERVAL '{int(max_age_seconds)}' SECOND"))
    return streams.withColumn("behind", behind).where(
        (behind > 0) & ((behind >= min_events) | (F.col("head_recorded_at") <= oldest))) \
        .orderBy(F.desc("behind"), *STREAM_KEY)


def newest_runs(runs: DataFrame, scope: Scope, limit: int = 50) -> DataFrame:
    return of_tenant(runs, *scope).drop("report").orderBy(F.desc("started_at"), F.desc("run_id")).limit(within(limit, 200))


def list_exports(exports: DataFrame, scope: Scope, limit: int = 50) -> DataFrame:
    """Newest first."""
    return of_tenant(exports, *scope).orderBy(F.desc("created_at"), F.desc("export_id")).limit(within(limit, 200))


def list_keys(keys: DataFrame, scope: Scope) -> DataFrame:
    """Oldest first."""
    return of_tenant(keys, *scope).orderBy("activated_at", "key_id")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest completed run of stream or project scope, per project."""
    done = runs.where(F.col("completed_at").isNotNull() & F.col("scope").isin("stream", "project"))
    return newest_per_key(done, ["tenant_id", "project_id"], ["completed_at", "run_id"])


def live(records: DataFrame, now: str) -> DataFrame:
    return records.where(F.col("expires_at") > now)


def expired(records: DataFrame, now: str) -> DataFrame:
    return records.where(F.col("expires_at") <= now)


def expire_exports(exports: DataFrame, now: str) -> DataFrame:
    """Completed exports past their expiry become expired."""
    return exports.withColumn("status", F.when(
        (F.col("status") == "completed") & (F.col("expires_at") < now), F.lit("expired")).otherwise(F.col("status")))


def replay_decisions(requests: DataFrame, known: DataFrame, now: str) -> DataFrame:
    """replay | conflict | fresh for requests with an idempotency key.

    Unique per (project_id, key); a record past its expiry does not count. Of
    requests of one batch with the same new key the one with the least
    (endpoint, hash) is fresh, once; ``request_id``, where there is one, comes first.
    """
    side = live(known, now).select("project_id", "idempotency_key", F.col("endpoint").alias("_endpoint"),
                                   F.col("request_hash").alias("_hash"), "event_ids")
    place = [c for c in ("request_id", "endpoint", "request_hash") if c in requests.columns]
    keyless = F.col("idempotency_key").isNull()                                   # fresh each; not one group
    batch = Window.partitionBy("project_id", "idempotency_key", F.when(keyless, F.xxhash64(*place))).orderBy(*place)
    joined = requests.join(side, ["project_id", "idempotency_key"], "left") \
        .withColumn("_first", keyless | (F.row_number().over(batch) == 1)) \
        .withColumn("_new", F.col("_hash").isNull()) \
        .withColumn("_endpoint", F.coalesce("_endpoint", F.first("endpoint").over(batch))) \
        .withColumn("_hash", F.coalesce("_hash", F.first("request_hash").over(batch)))
    same = F.col("_endpoint").eqNullSafe(F.col("endpoint")) & F.col("_hash").eqNullSafe(F.col("request_hash"))
    return joined.withColumn(
        "decision", F.when(F.col("_new") & F.col("_first"), F.lit("fresh")).when(same, F.lit("replay"))
        .otherwise(F.lit("conflict"))).withColumn("event_ids", F.when(F.col("decision") == "replay", F.col("event_ids"))) \
        .drop("_endpoint", "_hash", "_first", "_new")


def record_requests(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Idempotency table after accepting fresh requests: expired records with the same key are replaced."""
    keys = ["project_id", "idempotency_key"]
    return known.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
