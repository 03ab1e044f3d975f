"""Byte-level BPE in numpy matrices.

Words are split into pieces, distinct pieces of similar length become rows of a
padded matrix, and in each round every row merges its leftmost pair of least
rank; the pair's rank comes from a hash table over all pairs of tokens that
make a token. The row is then compacted by one column, and rows without a pair
left leave the matrix. Pieces over WIDE bytes are walked alone, with minima of
blocks in place of compaction. Decoding gathers token bytes by offset.

Defined results: null text counts as empty and has no ids; an empty table gives
an empty table; other columns pass through; ids that are null or not in the
vocabulary decode to no bytes; rows are treated alone, so ties and repeated
rows do not matter.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from tracewright.llm.tokens import WordCache, slices

NONE = np.int32(2**31 - 1)
#: Cells of a matrix.
CELLS = 1 << 20
#: Bytes above which a piece is walked alone.
WIDE = 1024
#: Slots that share a minimum there.
_BLOCK = 512


class PairTable:
    """(left, right) -> rank of the merged token, by open addressing with linear probes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        at, rest, self.probes = self._home(key), np.arange(len(key)), 0
        while len(rest):
            self.probes += 1
            free = rest[self.keys[at[rest]] == -1]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = key[put], rank[put]
            rest = rest[self.keys[at[rest]] != key[rest]]
            at[rest] = (at[rest] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair makes no token. Negative ids are padding."""
        key = (left.astype(np.int64) << 32) | right
        at = self._home(key)
        found = self.keys[at]
        out = np.where((found == key) & (left >= 0) & (right >= 0), self.values[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1) & (left >= 0) & (right >= 0))
        flat_key, flat_out, at = key.ravel(), out.reshape(-1), at.ravel()
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = open_[found == flat_key[open_]]
            flat_out[hit] = self.values[at[hit]]
            open_ = open_[(found != flat_key[open_]) & (found != -1)]
        return flat_out.reshape(key.shape)


class ByteBpe:
    """Encoder and decoder of one rank file; kept per worker."""
    _made: dict[tuple, ByteBpe] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        size = max(self.ranks.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        lengths = np.zeros(size, np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)
        self.cache = WordCache(self.encode_words)

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def encode_words(self, words: list[str]) -> list[bytes]:
        split = [[w] if w[1:].isalpha() and w[0] == " " else self.pattern.findall(w) for w in words]
        distinct = list({p: None for pieces in split for p in pieces})
        ids = dict(zip(distinct, self.merge([p.encode() for p in distinct])))
        return [ids[s[0]] if len(s) == 1 else b"".join(map(ids.__getitem__, s)) for s in split]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as bytes of self.dtype."""
        out: list[bytes] = [b""] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole], self.dtype).tobytes()
            elif len(p) > WIDE:
                out[i] = self.walk(p).astype(self.dtype).tobytes()
            else:
                todo.append(i)
        todo.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(todo):
            # a bucket: rows whose longest is at most a quarter longer than the shortest
            shortest, end = len(pieces[todo[at]]), at
            while end < len(todo) and len(pieces[todo[end]]) <= shortest * 1.25 + 1 and (end - at) * len(pieces[todo[end]]) < CELLS:
                end += 1
            rows = todo[at:end]
            for i, ids in zip(rows, self.rounds([pieces[i] for i in rows])):
                out[i] = ids
            at = end
        return out

    def rounds(self, pieces: list[bytes]) -> list[bytes]:
        n, width = len(pieces), max(map(len, pieces))
        tokens = np.full((n, width), -1, np.int32)
        lengths = np.array([len(p) for p in pieces])
        tokens[np.arange(width) < lengths[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs(tokens[:, :-1], tokens[:, 1:])
        who, out = np.arange(n), [b""] * n
        while len(who):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(who), np.int64)
            best = ranks[np.arange(len(who)), at] if ranks.shape[1] else np.full(len(who), NONE)
            over = best == NONE
            for k in np.flatnonzero(over):
                row = tokens[k]
                out[who[k]] = row[row >= 0].astype(self.dtype).tobytes()
            if over.all():
                break
            if over.any():
                tokens, ranks, at, best, who = tokens[~over], ranks[~over], at[~over], best[~over], who[~over]
            row = np.arange(len(who))
            tokens[row, at] = best
            columns = np.arange(tokens.shape[1] - 1)
            tokens = np.take_along_axis(tokens, columns + (columns > at[:, None]), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs(tokens[left, at[left] - 1], tokens[left, at[left]])
            right = np.flatnonzero(at < ranks.shape[1])
            ranks[right, at[right]] = self.pairs(tokens[right, at[right]], tokens[right, at[right] + 1])
        return out

    def walk(self, piece: bytes) -> np.ndarray:
        """One long piece: merged slots stay empty, and minima of blocks find the leftmost least rank."""
        tokens = self.first[np.frombuffer(piece, np.uint8)]
        n = len(tokens)
        blocks = -(-n // _BLOCK)
        ranks = np.full(blocks * _BLOCK, NONE, np.int32)
        ranks[:n - 1] = self.pairs(tokens[:-1], tokens[1:])
        minima = ranks.reshape(blocks, _BLOCK).min(1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        one = np.empty(1, np.int32), np.empty(1, np.int32)

        def put(i: int, value: int) -> None:
            ranks[i] = value
            b = i // _BLOCK
            minima[b] = ranks[b * _BLOCK:(b + 1) * _BLOCK].min()

        def pair(i: int, j: int) -> int:
            one[0][0], one[1][0] = tokens[i], tokens[j]
            return int(self.pairs(*one)[0])

        while True:
            b = int(minima.argmin())
            best = minima[b]
            if best == NONE:
                break
            i = b * _BLOCK + int(ranks[b * _BLOCK:(b + 1) * _BLOCK].argmin())
            j = after[i]
            tokens[i], tokens[j] = best, -1
            put(j, NONE)
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            put(i, pair(i, k) if k < n else NONE)
            if before[i] >= 0:
                put(before[i], pair(before[i], i))
        return tokens[tokens >= 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, one after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)]


def _with_column(schema: StructType, name: str, kind) -> StructType:
    if name in schema.names:
        raise ValueError(f"the table already has a column {name}; name another")
    return StructType(list(schema.fields)).add(name, kind)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the token ids of a text column, array<int>."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for a, b in slices(texts):
                made = bpe.cache(texts[a:b])
                ends = np.cumsum([0, *map(len, made)]) // bpe.dtype.itemsize
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(made), bpe.dtype).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, ids], [*batch.schema.names, ids_col])
    return docs.mapInArrow(run, _with_column(docs.schema, ids_col, ArrayType(IntegerType())))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds the bytes that a column of ids stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                column = part.column(ids_col)
                offsets = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
                flat = column.flatten()
                ids = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                bad = (ids < 0) | (ids >= len(bpe.lengths))
                parts = []
                for x, y in zip(np.concatenate([[0], offsets[:-1]]), offsets):
                    parts.append(bpe.decode(ids[x:y][~bad[x:y]]).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(parts, pa.binary())], [*batch.schema.names, bytes_col])
    return rows.mapInArrow(run, _with_column(rows.schema, bytes_col, BinaryType()))
