"""Joins against side tables that may or may not be small."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000
SALTS = 64


def lookup_join(rows: DataFrame, side: DataFrame, on: list[str], how: str = "left", *,
                max_rows: int = BROADCAST_ROWS, salts: int = SALTS, spread: str = "event_id",
                small: bool | None = None) -> DataFrame:
    """Join rows to a side table on keys that can be extremely uneven.

    A side of at most ``max_rows`` rows (counted, not guessed) is broadcast.
    A larger one is repeated per salt and joined on (keys, salt), so a key that
    a third of all rows share is spread over ``salts`` tasks. ``how`` is inner,
    left, left_semi or left_anti; the side must be unique on the keys for left.
    """
    if is_small(side, max_rows) if small is None else small:
        return rows.join(F.broadcast(side), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def is_small(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return side.limit(max_rows + 1).count() <= max_rows


def bounded(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint, if a count proves it small enough."""
    return F.broadcast(side) if is_small(side, max_rows) else side
