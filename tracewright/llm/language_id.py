"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds those
of its letters, the earlier ones permuted once more each: roll(a, 2) * roll(b, 1) * c.
A document is the sum of the vectors of its letter trigrams, a language the sum
of its documents, and a document gets the language of the largest cosine.

Sums are taken over counts: a batch counts the trigrams of each document and
multiplies the counts with the vectors of the trigrams that occur.

Defined results: null text or text without a letter is `und` with score 0, as is
every document when nothing was learned; equal cosines go to the language whose
name sorts first; rows are treated alone, so repeated rows get equal answers;
a null id counts as not held out; an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import releasing
from tracewright.llm.tokens import slices

DIMENSIONS, SEED, UNKNOWN = 1024, 20_17, "und"
#: Symbols: 0 for all that is no letter, a to z, and the other letters folded into the rest.
SYMBOLS = 64
_OWN = 27
CODES = SYMBOLS ** 3
#: Rows whose vectors are held at a time, trigrams the same, and cells of a block of their counts.
BLOCK, WIDTH, CELLS = 4096, 1024, 1 << 19
#: Characters that are counted or judged at a time.
SLICE_CHARS = 1 << 19
_table: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Symbol of every code point."""
    if not _table:
        out = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                out[cp] = low - 96 if 97 <= low <= 122 else _OWN + (low - 0xDF) % (SYMBOLS - _OWN)
        _table.append(out)
    return _table[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each letter trigram; runs of other characters are one border symbol, also at both ends."""
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    symbols = _symbols()[points]
    rows = np.concatenate([np.zeros(1, np.int32), rows])
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    keep[0] = True
    symbols, rows = symbols[keep].astype(np.int32), rows[keep]
    code = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    inside = (rows[1:-1] == rows[2:]) & (symbols[1:-1] > 0)
    spread = (rows[1:-1] == rows[2:]) & (symbols[1:-1] == 0) & (rows[:-2] == rows[1:-1])
    own = inside | spread
    return rows[1:-1][own], code[own]


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each code."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
    a, b, c = codes // SYMBOLS ** 2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


def _row_slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of bounded characters and rows."""
    for a, b in slices(texts, SLICE_CHARS):
        for x in range(a, b, BLOCK):
            yield x, min(x + BLOCK, b)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language -> prototype, from all rows with a language. What reaches the driver is one count per language and trigram."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {n: i for i, n in enumerate(names)}
            of = np.array([number[x] for x in langs])
            total: dict[int, np.ndarray] = {}
            for a, b in slices(texts, SLICE_CHARS):
                row, code = trigrams(texts[a:b])
                lang = of[a:b][row]
                for i in np.unique(lang).tolist():
                    total[i] = total.get(i, 0) + np.bincount(code[lang == i], minlength=CODES)
            for i, counts in total.items():
                found = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([names[i]] * len(found), pa.string()),
                                                  "code": pa.array(found, pa.int64()), "n": pa.array(counts[found], pa.int64())})
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = rows.mapInArrow(releasing(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    lang, code, n = (found.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "code", "n"))
    out = {}
    for name in sorted(set(lang.tolist())):
        own, total = np.flatnonzero(lang == name), np.zeros(DIMENSIONS)
        for a in range(0, len(own), 4096):
            part = own[a:a + 4096]
            total += n[part] @ trigram_vectors(code[part]).astype(np.float64)
        out[name] = total
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text",
             lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its cosine (0 where negative). A table that has columns of these names is refused."""
    taken = {lang_pred.lower(), score.lower()} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"the table already has {sorted(taken)}; name other result columns")
    names = sorted(prototypes)
    unit = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in names], np.float32).reshape(-1, DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(CODES, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for a, b in _row_slices(texts):
                row, code = trigrams(texts[a:b])
                used = np.flatnonzero(np.bincount(code, minlength=CODES))
                place[used] = np.arange(len(used))
                starts = np.searchsorted(row, np.arange(b - a + 1))
                best, cosine = [UNKNOWN] * (b - a), np.zeros(b - a)
                # blocks of trigrams and of rows, so that neither many letters nor many rows need more memory
                bundles = np.zeros((b - a, DIMENSIONS), np.float32) if names and len(used) else None
                for u in range(0, len(used), WIDTH) if bundles is not None else ():
                    width = min(WIDTH, len(used) - u)
                    vectors = trigram_vectors(used[u:u + width]).astype(np.float32)
                    spots = place[code] - u
                    inside = np.flatnonzero((spots >= 0) & (spots < width)) if len(used) > WIDTH else slice(None)
                    rows_in, spots = row[inside], spots[inside]
                    step = max(1, CELLS // width)
                    edges = np.searchsorted(rows_in, np.arange(0, b - a + step, step))
                    for x, lo, hi in zip(range(0, b - a, step), edges[:-1].tolist(), edges[1:].tolist()):
                        y = min(x + step, b - a)
                        counts = np.bincount((rows_in[lo:hi] - x) * width + spots[lo:hi], minlength=(y - x) * width).reshape(y - x, -1).astype(np.float32)
                        bundles[x:y] += counts @ vectors
                for x in range(0, b - a, BLOCK) if bundles is not None else ():
                    y, bundle = min(x + BLOCK, b - a), bundles[x:x + BLOCK]
                    sims = bundle @ unit.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-30)
                    pick = sims.argmax(1)
                    for i in np.flatnonzero(np.diff(starts[x:y + 1])).tolist():
                        best[x + i], cosine[x + i] = names[pick[i]], min(1.0, max(0.0, float(sims[i, pick[i]])))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(best, pa.string()), pa.array(cosine, pa.float64())],
                                                 [*batch.schema.names, lang_pred, score])
    from pyspark.sql.types import DoubleType, StringType, StructType
    schema = StructType(list(docs.schema.fields)).add(lang_pred, StringType()).add(score, DoubleType())
    return docs.mapInArrow(releasing(run), schema)
