"""Vector codes: four codebook indexes a vector, assigned through memoised grid cells.

Each component x counts as the integer floor(1024 * x), so all arithmetic is
exact. A vector's parts are assigned to the nearest entry of their position's
codebook: the part's coarse cell is looked up; a cell met for the first time
gets the entries that no other entry beats everywhere in its box (their least
distance to the box is not above the smallest of the largest distances); only
those are evaluated exactly. The memo of a task is bounded and may be cleared
at any time, which costs work and changes nothing.

Defined results: vectors that are null, or hold null or non-finite components,
are dropped, and so are empty ones; repeated rows are coded alike and all count;
equal distances go to the lower index; rows without an id order after all
others when the codebooks begin; equal ids order by vector; null labels are one
label; with fewer than 256 rows the codebooks have as many entries; an empty
table gives an empty table; columns other than those named are not read. Kept
vectors must be of one length, a multiple of four, with components below
131,072; other tables raise ValueError.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Width of a coarse cell in scaled units, and the cells that a task keeps for each part.
CELL, MEMO_CELLS = 96, 20_000
#: Exact evaluations at a time.
PAIRS = 1 << 16
_LARGEST = 131_072


class Cells:
    """Nearest entries of one codebook (entries x width, int64), by memoised cells."""

    def __init__(self, book: np.ndarray, cell: int = CELL, memo_cells: int = MEMO_CELLS):
        self.book, self.cell, self.most = book, cell, memo_cells
        self.memo: dict[bytes, np.ndarray] = {}
        self.boxes = self.evaluated = 0  # what was done, for tests and measurements

    def _candidates(self, coarse: np.ndarray) -> list[np.ndarray]:
        """Entries not dominated across the box of each cell."""
        least = np.zeros((len(coarse), len(self.book)), np.int64)
        most = np.zeros_like(least)
        for j in range(coarse.shape[1]):
            level, of = np.unique(coarse[:, j], return_inverse=True)
            low = (level * self.cell)[:, None]
            high, entry = low + self.cell - 1, self.book[:, j][None, :]
            near = np.maximum(np.maximum(low - entry, entry - high), 0)
            far = np.maximum(np.abs(entry - low), np.abs(entry - high))
            least += (near * near)[of]
            most += (far * far)[of]
        keep = least <= most.min(axis=1, keepdims=True)
        self.boxes += len(coarse)
        return [np.flatnonzero(k).astype(np.int16) for k in keep]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance of each row."""
        index, best = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        if not len(rows):
            return index, best
        coarse = np.ascontiguousarray(rows // self.cell)
        keys, first, of = np.unique(coarse.view(np.dtype((np.void, coarse.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        names = [k.tobytes() for k in keys]
        new = [i for i, k in enumerate(names) if k not in self.memo]
        found: dict[int, np.ndarray] = {}
        for a in range(0, len(new), 1024):
            part = new[a:a + 1024]
            found.update(zip(part, self._candidates(coarse[first[part]])))
        lists = [found[i] if i in found else self.memo[k] for i, k in enumerate(names)]
        if len(self.memo) + len(new) > self.most:
            self.memo = {}
        self.memo.update((names[i], found[i]) for i in new[:self.most])
        sizes = np.array([len(x) for x in lists])[of]
        start = 0
        while start < len(rows):
            ends = np.cumsum(sizes[start:start + PAIRS])
            stop = start + max(1, int(np.searchsorted(ends, PAIRS, "right")))
            own = np.arange(start, stop)
            row = np.repeat(own, sizes[own])
            entry = np.concatenate([lists[c] for c in of[own]]).astype(np.int64)
            apart = rows[row] - self.book[entry]
            distance = np.einsum("ij,ij->i", apart, apart)
            starts = np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
            best[own] = np.minimum.reduceat(distance, starts)
            hits = np.flatnonzero(distance == best[row])
            _, at = np.unique(row[hits], return_index=True)
            index[own] = entry[hits[at]]  # entries of a list ascend: the lowest of equals
            self.evaluated += len(row)
            start = stop
        return index, best


def scaled(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, ints of the rows that take part."""
    vector = F.col(vector_col)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (rows.filter(vector.isNotNull() & (F.size(vector) > 0)).filter(fine)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                    F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("ints")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _batches(batches: Iterator[pa.RecordBatch], column: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _sums(books: list[np.ndarray], width: int):
    own = width // PARTS

    def run(batches):
        cells = [Cells(b) for b in books]
        total = np.zeros((PARTS, len(books[0]), own), np.int64)
        n = np.zeros((PARTS, len(books[0])), np.int64)
        for batch in _batches(batches, 0):
            rows = _matrix(batch.column(0), width)
            for p in range(PARTS):
                part = np.ascontiguousarray(rows[:, p * own:(p + 1) * own])
                index, _ = cells[p].nearest(part)
                np.add.at(total[p], index, part)
                n[p] += np.bincount(index, minlength=len(n[p]))
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(np.repeat(p, own), pa.int64()), "entry": pa.array(np.repeat(e, own), pa.int64()),
                                          "place": pa.array(np.tile(np.arange(own), len(p)), pa.int64()),
                                          "n": pa.array(np.repeat(n[p, e], own), pa.int64()), "total": pa.array(total[p, e].ravel(), pa.int64())})
    return run


def fit(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks from rows of `scaled`. One row per entry and component reaches the driver in a round."""
    shape = rows.agg(F.min(F.size("ints")), F.max(F.size("ints")), F.max(F.array_max(F.transform("ints", F.abs)))).first()
    if shape[0] is None:
        return []
    if shape[0] != shape[1] or shape[0] % PARTS or shape[2] >= _LARGEST * SCALE:
        raise ValueError("vectors must be of one length that four divides, with components below 131072")
    width, own = shape[0], shape[0] // PARTS
    first = np.array([r.ints for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()], np.int64)
    books = [np.ascontiguousarray(first[:, p * own:(p + 1) * own]) for p in range(PARTS)]
    for _ in range(rounds):
        made = (rows.select("ints").mapInArrow(_sums(books, width), "part long, entry long, place long, n long, total long")
                .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect())
        for r in made:
            books[r.part][r.entry, r.place] = int(r.total) // r.n
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (hex), error of rows of `scaled`."""
    own = books[0].shape[1] if books else 0

    def run(batches):
        cells = [Cells(b) for b in books]
        for batch in _batches(batches, 2):
            ints = _matrix(batch.column(2), own * PARTS)
            error, codes = np.zeros(len(ints), np.int64), np.empty((len(ints), PARTS), np.uint8)
            for p in range(PARTS):
                index, distance = cells[p].nearest(np.ascontiguousarray(ints[:, p * own:(p + 1) * own]))
                codes[:, p] = index
                error += distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                                              pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "ints").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    rows = written(scaled(table, id_col, vector_col, label_col), "vectors-scaled")
    books = fit(rows)
    out = written(encode(rows, books), "vector-codes")
    # the sums have one row per label; a label that most rows share is one row of them and its rows stay where they are
    sums = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    few = sums.count() <= 100_000
    joined = out.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
