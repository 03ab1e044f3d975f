"""Headline timings: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS select input and
cores. Every query runs once on the small tables first, so that what is timed
is the work and not the start of Python workers and compilers.
"""
from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("tracewright-bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    from tracewright.config import VerifyOptions
    from tracewright.plans import overview as view
    from tracewright.plans.prepare import prepare
    from tracewright.plans.seal import seal, stream_heads
    from tracewright.plans.throughput import submit, tamper
    from tracewright.plans.verify import verify_streams
    from tracewright.session import written
    from tracewright.sources.readers import synth_events
    from tracewright.suite import data

    took: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        out = work()
        took[name] = round(time.perf_counter() - start, 3)
        return out

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    n = data.raw(spark, sf_dir, "events").count()
    took["events"] = n
    requests = synth_events(spark, n)
    keys = data.keys(spark)
    timed("prepare", lambda: drain(prepare(requests)))
    ready = written(submit(requests, data.TENANT, data.PROJECT, data.KEY["b"], data.NOW), "bench-prepared")
    one = timed("seal_one_stream", lambda: written(seal(ready, data.SEEDS), "bench-chain"))
    heads = written(stream_heads(one), "bench-heads")
    timed("verify_one_stream", lambda: verify_streams(one, keys, streams=heads).reports().collect())
    found = timed("tamper_one_stream", lambda: verify_streams(
        tamper(one, n // 2 + 1), keys, streams=heads).reports().select("first_failure.code", "first_failure.sequence").collect())
    assert [tuple(r) for r in found] == [("payload_hash_mismatch", n // 2 + 1)], found

    chain = timed("seal_activity", lambda: data.chain(spark, sf_dir))
    streams, checkpoints = data.streams(spark, sf_dir), data.checkpoints(spark, sf_dir)
    timed("verify_activity", lambda: verify_streams(chain, keys, streams=streams, checkpoints=checkpoints).reports().collect())
    timed("verify_without_signatures", lambda: verify_streams(
        chain, keys, streams=streams, options=VerifyOptions(signatures=False)).reports().collect())
    results = data.run_tables(spark, sf_dir)[1]
    timed("list_page", lambda: view.list_events(chain, results, data.SCOPE, stream="click").collect())
    timed("list_failed", lambda: view.list_events(chain, results, data.SCOPE, status="failed").collect())
    timed("overview", lambda: [df.collect() for df in view.overview(chain, streams, results, data.SCOPE, data.NOW).values()])
    timed("prepare_orders", lambda: drain(prepare(data.requests(spark, sf_dir))))
    return took


def main() -> None:
    spark = session()
    if os.path.isdir(WARM_DIR) and WARM_DIR != SF_DIR:
        run(spark, WARM_DIR)
    took = run(spark, SF_DIR)
    events = took.pop("events")
    rates = {f"{name}_events_per_sec": round(events / took[name]) for name in
             ("prepare", "seal_one_stream", "verify_one_stream", "seal_activity", "verify_activity")}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(SF_DIR.rstrip("/")), "events": events, "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
