"""Small helpers shared by the operators of this folder."""
from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tracewright.session import checkpoint_root, written

__all__ = ["checkpoint_root", "written", "table", "text_or_empty", "local_table", "arrow_rows", "small_batches", "releasing", "binom_floor", "free_names"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few given rows. It is sent in Arrow: from a list of tuples Spark would start Python workers of their own kind for it on
    the executors, which stay there beside those of the operators."""
    kind = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pydict({f.name: pa.array(c, to_arrow_type(f.dataType)) for f, c in zip(kind, zip(*rows))}), kind)


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to Python; only a single row may be larger.
BATCH_BYTES = 4 << 20


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of a batch that goes to Python, for the actions inside, and BATCH_BYTES at most; rows can be large here."""
    before = {name: spark.conf.get(name) for name in (_ROWS, _BYTES)}
    spark.conf.set(_ROWS, str(rows))
    _bound(spark, _BYTES, BATCH_BYTES)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _bound(spark: SparkSession, name: str, most: int) -> None:
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(name).lower()).groups()
    now = int(number) << 10 * "_kmgtp".index(unit or "_")
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = BATCH_BYTES) -> None:
    """At most so many rows and bytes in a batch that goes to Python, from now on in this session: for lazy results with whole texts."""
    _bound(spark, _ROWS, rows)
    _bound(spark, _BYTES, size)


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches. Workers are used again, so what its task freed goes back to the system at its end."""
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()
    return released


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of `docs` has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def binom_floor(k: int, p: float, risk: float) -> int:
    """The largest c for which k draws with chance p give fewer than c hits at most with chance `risk`."""
    below, term = 0.0, (1 - p) ** k
    for c in range(k + 1):
        below += term
        if below > risk:
            return c
        term *= (k - c) / (c + 1) * p / (1 - p)
    return k
