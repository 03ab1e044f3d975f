"""Write-once files: one document per checkpoint, created only where there is none.

A Spark writer of its own: tasks create the files, each with an exclusive link
that a second run cannot repeat, and write what happened as receipts; the driver
commits the receipts of the tasks that count. A repeated task knows its own
files by the run's staged copy and does not take them for another run's.
"""
from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tracewright.config import ID_PATTERN, STREAM_PATTERN
from tracewright.schemas import STREAM_KEY
from tracewright.session import durable
from tracewright.sources.sinks import checkpoint_line

_RECEIPT = "entry string, anchored boolean"


def shared_folder(path: str) -> str:
    """A folder that tasks can link files in; other stores have no exclusive creation that they can use."""
    local = path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
    if "://" in local:
        raise ValueError(f"write-once files need a mounted file system, not {path}")
    return os.path.abspath(local)


def create_once(folder: str, staged: str, name: str, document: str) -> bool:
    """Create folder/name with the document. True where this run's staged copy is the file, also when asked again."""
    os.makedirs(folder, exist_ok=True)
    os.makedirs(os.path.dirname(staged), exist_ok=True)
    own = f"{staged}.{uuid.uuid4().hex}"
    with open(own, "x", encoding="utf-8") as out:
        out.write(document + "\n")
        out.flush()
        os.fsync(out.fileno())
    os.chmod(own, 0o440)
    try:
        os.link(own, staged)
    except FileExistsError:
        pass                                       # an earlier attempt of this task
    os.unlink(own)
    final = os.path.join(folder, name)
    try:
        os.link(staged, final)
        return True
    except FileExistsError:
        return os.path.samefile(staged, final)


@dataclass
class Receipts(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, run: str):
        self.folder, self.run = folder, run

    @property
    def receipts(self) -> str:
        return os.path.join(self.folder, "_receipts", self.run)

    @property
    def staging(self) -> str:
        return os.path.join(self.folder, "_staging", self.run)

    def write(self, iterator: Iterator) -> Receipts:
        """Rows (entry, document): entry is the path below the folder, without its ending."""
        os.makedirs(self.receipts, exist_ok=True)
        name = f"{uuid.uuid4().hex}.json"
        with open(os.path.join(self.receipts, name), "x", encoding="utf-8") as out:
            for row in iterator:
                folder, base = os.path.split(row.entry)
                done = create_once(os.path.join(self.folder, folder), os.path.join(self.staging, row.entry), base + ".json", row.document)
                out.write(json.dumps({"entry": row.entry, "anchored": done}) + "\n")
        return Receipts(name)

    def commit(self, messages: list) -> None:
        with open(os.path.join(self.receipts, "committed"), "x", encoding="utf-8") as out:
            out.writelines(m.name + "\n" for m in messages if m is not None)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        """Files that were created stay: they are whole, and write-once."""


class WriteOnce(DataSource):
    """Format ``write_once`` with the options path and run."""

    @classmethod
    def name(cls) -> str:
        return "write_once"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["run"])


def committed_receipts(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """entry, anchored of a run's committed tasks."""
    base = os.path.join(folder, "_receipts", run)
    with open(os.path.join(base, "committed"), encoding="utf-8") as listed:
        files = ["file://" + os.path.join(base, line.strip()) for line in listed]
    return spark.read.schema(_RECEIPT).json(files) if files else spark.createDataFrame([], _RECEIPT)


def anchor_files(checkpoints: DataFrame, path: str, run: str | None = None) -> DataFrame:
    """Publish each checkpoint as path/tenant/project/stream/sequence-id.json; return a receipt per row.

    A file that exists is never touched: the checkpoint is reported as failed, as
    are copies beside the first within the rows, and identifiers unfit for a path.
    """
    spark, folder, run = checkpoints.sparkSession, shared_folder(path), run or uuid.uuid4().hex
    spark.dataSource.register(WriteOnce)
    safe = F.col("tenant_id").rlike(ID_PATTERN) & F.col("project_id").rlike(ID_PATTERN) \
        & F.col("stream").rlike(STREAM_PATTERN) & F.col("checkpoint_id").rlike(ID_PATTERN) & F.col("sequence").isNotNull()
    named = checkpoints.withColumn("safe", F.coalesce(safe, F.lit(False))).withColumn("entry", F.when(
        F.col("safe"), F.concat_ws("/", *STREAM_KEY, F.format_string("%012d-%s", F.col("sequence"), F.col("checkpoint_id")))))
    order = [c for c in ("checkpoint_hash", "head_hash", "created_at") if c in checkpoints.columns]
    copy = F.row_number().over(Window.partitionBy("entry").orderBy(*order))
    first, others = named.where("safe"), named.where("NOT safe").withColumn("copy", F.lit(1))
    judged = durable(first.withColumn("copy", copy).unionByName(others))       # decided once, before files exist
    spark.createDataFrame([], "entry string")      # makes the session this thread's own, through which the format is found
    judged.where("safe AND copy = 1").select("entry", checkpoint_line().alias("document")) \
        .write.format("write_once").option("path", folder).option("run", run).mode("append").save()
    receipts = committed_receipts(spark, folder, run).withColumn("copy", F.lit(1))
    done = F.coalesce("anchored", F.lit(False))
    return judged.join(receipts, ["entry", "copy"], "left").select(
        "checkpoint_id", F.lit("file").alias("provider"), F.when(done, F.lit("anchored")).otherwise(F.lit("failed")).alias("status"),
        F.when(done, F.concat("entry", F.lit(".json"))).alias("receipt"),
        F.when(~F.col("safe"), F.lit("identifiers are not fit for a path")).when(~done, F.lit("there is one already")).alias("error"))
