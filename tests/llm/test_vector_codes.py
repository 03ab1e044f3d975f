"""Vector codes: cells against all distances, and the defined cases."""
import hashlib

import numpy as np
import pytest

from tracewright.llm import vector_codes
from tracewright.llm.vector_codes import Cells


@pytest.mark.parametrize("cell", [1, 7, 96, 5000])
@pytest.mark.parametrize("memo", [3, 10_000])
def test_cells_find_the_nearest_entry(cell, memo):
    rng = np.random.default_rng(cell)
    book = rng.integers(-300, 300, (256, 6))
    book[9] = book[3]  # a tie
    cells = Cells(book, cell, memo)
    for _ in range(3):
        rows = np.concatenate([rng.integers(-400, 400, (500, 6)), np.repeat(book[3:4], 200, 0)])
        index, distance = cells.nearest(rows)
        every = ((rows[:, None, :] - book[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert len(cells.memo) <= memo
    assert cells.evaluated <= 3 * 700 * 256


def test_copies_share_a_cell_and_most_entries_are_not_evaluated():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (256, 4))
    rows = centres[rng.integers(0, 256, 5000)] + rng.integers(-4, 5, (5000, 4))
    cells = Cells(centres, 96)
    cells.nearest(rows)
    assert cells.boxes < 1500 and cells.evaluated < 5000 * 256 // 20


def plain(rows):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], g) for i, v, g in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return []
    x = np.array([r[1] for r in kept])
    own = x.shape[1] // 4
    books = [x[:256, p * own:(p + 1) * own].copy() for p in range(4)]
    for turn in range(5):
        picks = []
        for p in range(4):
            part = x[:, p * own:(p + 1) * own]
            d = ((part[:, None] - books[p][None]) ** 2).sum(2)
            picks.append((d.argmin(1), d.min(1)))
            if turn < 4:
                for e in set(picks[-1][0].tolist()):
                    members = part[picks[-1][0] == e]
                    books[p][e] = [int(s) // len(members) for s in members.sum(0)]
    error = sum(d for _, d in picks)
    by: dict = {}
    for r, e in zip(kept, error):
        by[r[2]] = by.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{int(p[0][i]):02x}" for p in picks), int(error[i]), by[r[2]], sha) for i, r in enumerate(kept)), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, ints string, code string, error int, of string"


def codes(spark, rows):
    table = spark.createDataFrame([(i, v, g, "a", "b", 1, "c") for i, v, g in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in vector_codes.coded(table).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(0, 0.2, 8).astype(np.float32).tolist(), int(i) % 3 if i % 7 else None) for i in rng.permutation(600)]
    rows += [(i, None, 1) for i in range(3)] + [(700, [float("nan")] * 8, 1), (701, [float("inf")] + [0.0] * 7, 2), (702, [None] + [0.0] * 7, 2), (703, [], 1)]
    rows += [(704, [0.25] * 8, 1)] * 300 + [(None, [0.5] * 8, None)]
    assert codes(spark, rows) == plain(rows)


def test_small_and_empty_tables(spark):
    assert codes(spark, []) == []
    assert codes(spark, [(1, None, 2)]) == []
    few = [(5, [1.0, 2.0, 3.0, -4.0], 1), (3, [0.0, 0.1, -0.1, 0.0], None)]
    assert codes(spark, few) == plain(few)


def test_tables_of_other_shape_are_refused(spark):
    for rows in ([(1, [1.0] * 6, 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [2e5] * 4, 1)]):
        with pytest.raises(ValueError):
            codes(spark, rows)
