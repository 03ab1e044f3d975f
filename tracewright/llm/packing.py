"""Best-fit packing by sums of squares.

N(g) is the number of open sequences with a gap of g tokens. A piece goes where
the sum of N(g)^2 over all gaps becomes smallest: into an open sequence whose
gap fits, or into a new one. That keeps gaps of all sizes at hand, so nearly
all sequences end full. Pieces are packed in groups of bounded size, one task
each; what remains open after the first round is packed again over all groups.

Defined results: null text counts as empty and is one piece, the end token; only
longer documents are cut; repeated rows are packed once each; an empty table
packs into nothing; columns other than doc_id and text are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import releasing, text_or_empty, written
from tracewright.llm.tokens import TASK_WORDS, TextEncoder, arrow_slices

SIZE = 1024
#: Pieces that one task packs.
GROUP_PIECES = 200_000
#: What a round leaves open is packed again by the next.
ROUNDS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes the remainder."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, vocab_path: str, end_id: int = 2, size: int = SIZE, with_ids: bool = False, as_loaded: bool = False,
           slice_bytes: int = 2 << 20, cache_words: int = TASK_WORDS) -> DataFrame:
    """One row per piece of every document; with_ids adds the ids (binary, unsigned 32-bit little-endian). as_loaded: see TextEncoder.

    Smaller slices of texts and caches of words need less memory and more time; the rows are the same."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder(vocab_path, "<u2", as_loaded, cache_words)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in arrow_slices(texts, slice_bytes):
                rows = []
                for key, made in zip(keys[a:b], encode(texts.slice(a, b - a))):
                    ids = np.append(np.frombuffer(made, "<u2").astype("<u4"), np.uint32(end_id))
                    for i, (start, n) in enumerate(cut(len(ids), size)):
                        own = ids[start:start + n].tobytes()
                        rows.append((key, i, start, n, zlib.crc32(own), own if with_ids else None))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:6 if with_ids else 5]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[:len(kinds)])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(releasing(make), PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each length, in the order given, and the gap that each sequence keeps."""
    count = np.zeros(size + 1, np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    gaps: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # moving a sequence from gap g to g - s changes the sum by 2 (N(g - s) - N(g) + 1); gap 0 and new ones are not counted
        held = count[s:]
        after = count[:size + 1 - s]
        change = np.where(held > 0, 2 * (after - held + 1), never)
        if held[0] > 0:
            change[0] = 1 - 2 * held[0]
        if s < size:
            change[-1] = 2 * after[-1] + 1
        else:
            change[-1] = 0
        g = s + int(change.argmin())
        if g == size:
            k, offset[i] = len(gaps), 0
            gaps.append(size)
        else:
            k = open_by_gap[g].pop()
            count[g] -= 1
            offset[i] = size - g
        gaps[k] = g - s
        if g > s:
            open_by_gap[g - s].append(k)
            count[g - s] += 1
        sequence[i] = k
    return sequence, offset, np.array(gaps, np.int64)


def _packer(size: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        sequence, offset, gaps = sum_of_squares(table.column("length").to_numpy(), size)
        base = (TaskContext.get().partitionId() * ROUNDS + turn) << 32
        for name, values in (("sequence_id", base + sequence), ("offset", offset), ("gap", gaps[sequence])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        yield from table.to_batches()
    return run


def pack(found: DataFrame, size: int = SIZE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows of PIECES."""
    columns = found.columns
    found = written(found, "pieces")
    schema = PIECES + ", sequence_id long, offset long, gap long"

    def once(rows: DataFrame, turn: int) -> DataFrame:
        n = max(1, -(-rows.count() // group_pieces))
        # fixed orders, so that a repeated task packs alike: the largest first, in the next round mixed
        mixed = F.xxhash64("doc_id", "piece")
        order = [mixed] if turn % 2 else [F.col("length").desc(), mixed]
        dealt = rows.repartition(n, "doc_id", "piece").sortWithinPartitions(*order, "doc_id", "piece", "ids_crc32")
        return written(dealt.mapInArrow(releasing(_packer(size, turn)), schema), "packed")

    full, left = None, found
    for turn in range(ROUNDS):
        packed = once(left, turn)
        done = packed.filter("gap = 0") if turn < ROUNDS - 1 else packed
        full = done if full is None else full.unionByName(done)
        left = packed.filter("gap > 0").select(columns)
    return full.drop("gap")


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and ids (binary), from packed pieces and `pieces(..., with_ids=True)`."""
    rows = with_ids.select("doc_id", "piece", "ids").join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most `size` pieces
    return rows.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
