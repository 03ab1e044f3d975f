"""Jaccard join of word shingles over a token-group matrix.

1. A document is the set of hashes of its distinct five-word shingles. Equal
   sets are one class; only its representative goes on.
2. Of each set the SKETCH least hashes are kept. Two sets with a Jaccard
   similarity of 0.75 share at least LEAST_SHARED of them (all but once in
   10^12 such pairs; where both sets fit the sketch the bound is exact). Sets
   that share too few hashes with anything are out; those left are tried again
   with the WIDE_SKETCH least hashes. Of these, the most frequent may be left
   out, as many as cannot matter: similar sets still share one of the rest.
3. The rest is partitioned into groups of similar documents: those with the
   same most frequent hash, in chunks of bounded size. Groups are linked inside
   and with the first chunk of their key.
4. The token-group matrix holds for each of the hashes left over from step 2
   the groups with a member that has it, and which members: sketches with a
   prefix filter choose the groups, not the groups' full token unions. Where two
   groups meet that are not one component yet, the members that meet are fetched
   with their full sets; one whose overlap with the union of the other side's
   is below 0.75 of its own size passes it by, any other is intersected with them.
   The full sets decide, so no link is reported that is none.

Pairs inside a component are never expanded, and a group of near copies costs a
comparison with one chunk each.

Defined results: null or blank text has no shingles and is a component of its
own; a null id is linked with nothing and has a null component; rows that
repeat an id are one document with several texts: each row has the size of its
own set, the component is shared; an empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrow_rows, binom_floor, releasing, text_or_empty, written
from tracewright.llm.components import Joined, components
from tracewright.llm.tokens import slices
from tracewright.llm.url_cascade import bit_words, has

WORDS, PERCENT = 5, 75
#: Hashes of the first and of the second sketch, and how many of each two similar sets share, but once in 10^12 times.
SKETCH, WIDE_SKETCH = 64, 256
LEAST_SHARED = {k: binom_floor(k, PERCENT / 100, 1e-12) for k in (SKETCH, WIDE_SKETCH)}
#: Documents and shingles of a chunk, about; a chunk is one row.
CHUNK_DOCS, CHUNK_SHINGLES = 64, 1 << 16
#: Rows of a batch in Python: documents or pairs of chunks.
BATCH_ROWS = 200
#: Bits of the filter that keeps documents without partners out of a shuffle, 2 MB.
FILTER_BITS = 1 << 24
#: Characters whose shingles are taken at a time, and powers of a base that a worker keeps, 4 MB.
SLICE_CHARS, KEPT_POWERS = 1 << 18, 1 << 19
#: Members of a component in one hot key from which they are chunked apart from the rest.
APART = 8

_U = np.uint64
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, KEPT_POWERS), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= KEPT_POWERS:  # a longer one, for a very long text, ends with its slice
            _powers[base] = have
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    borders = np.cumsum([0, *(len(r) + 1 for r in raw)])
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    end = end[end > start[0]] if len(start) else end[:0]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power_table(_BASE, len(data))[:len(data)])])
    word = _mix((sums[end] - sums[start]) * _power_table(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, borders)
    n = len(word) - WORDS + 1
    rolled = sum((word[i:i + n] * _STEP[i] for i in range(WORDS)), np.zeros(max(n, 0), np.uint64)) if n > 0 else np.zeros(0, np.uint64)
    rolled = _mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a:b - WORDS + 1]))
        elif b > a:
            out.append(_mix((word[a:b] * _STEP[:b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts, SLICE_CHARS):
            sets = shingle_sets(texts[a:b])
            heads = [s[:SKETCH].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_mix(s + _U(1)).sum().view(np.int64) for s in sets], pa.int64()),
                pa.array([_mix(s ^ _U(_INVERSE)).sum().view(np.int64) for s in sets], pa.int64()),
                pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "n", "f1", "f2", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts, SLICE_CHARS):
            sets = shingle_sets(texts[a:b])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([s[:WIDE_SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64()))], ["rep", "n", "tokens", "wide"])


def open_groups(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]] | None) -> list[tuple[int, int]]:
    """Links between members (id, component, sorted set) of two groups, or within one (right None), of different components."""
    inside, right = right is None, left if right is None else right
    tokens = np.concatenate([s for _, _, s in right])
    owner = np.repeat(np.arange(len(right)), [len(s) for _, _, s in right])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([len(s) for _, _, s in right])
    joined, out = Joined(), []
    for i, (one, comp, own) in enumerate(left):
        lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        if 100 * np.count_nonzero(hi > lo) < PERCENT * len(own):
            continue  # the group's union bounds the overlap with any member
        width = hi - lo
        at = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())
        shared = np.bincount(owner[at], minlength=len(right))
        near = np.flatnonzero(100 * shared >= PERCENT * (len(own) + sizes - shared))
        for j in near.tolist():
            two, other, _ = right[j]
            if (not inside or j > i) and joined.top(comp) != joined.top(other):
                joined.join(comp, other)
                out.append((one, two))
    return out


def _members(cell) -> list[tuple[int, int, np.ndarray]]:
    return [(m["rep"], m["comp"], np.frombuffer(m["tokens"], np.uint64)) for m in cell]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for r in range(batch.num_rows):
            left = _members(batch.column(0)[r].as_py())
            right = batch.column(1)[r].as_py() if batch.num_columns > 1 else None
            links += open_groups(left, None if right is None else _members(right))
        a, b = zip(*links) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _chunked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds chunks (how many) and a chunk number, so that a chunk of `keys` has about CHUNK_DOCS rows or CHUNK_SHINGLES shingles."""
    counts = rows.groupBy(keys).agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_DOCS), F.ceil(F.sum("n") / CHUNK_SHINGLES), F.lit(1)).alias("chunks"))
    return rows.join(counts, keys).withColumn(name, F.pmod(F.xxhash64("rep"), F.col("chunks")))


def _sharing(rows: DataFrame, sketch: str, size: int) -> DataFrame:
    """The sets (rep, n) that share enough of a sketch with others: rep, n, key (the most frequent hash they share) and
    prefix (the hashes they share but for the most frequent, of which similar sets have one in common)."""
    heads = rows.select("rep", "n", F.explode(sketch).alias("token"))
    shared = heads.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    need = F.least(F.ceil(F.col("n") * PERCENT / 100), F.lit(LEAST_SHARED[size]))
    return (heads.join(shared, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
            .filter(F.size("ts") >= need)
            .select("rep", "n", F.element_at("ts", -1)["token"].alias("key"), F.slice("ts", 1, (F.size("ts") - need + 1).cast("int"))["token"].alias("prefix")))


def _likely(keys: DataFrame, key: Column) -> Column:
    """Whether `key`, a long, may be among the keys (one column), by a Bloom filter of at most FILTER_BITS; a join decides.
    Where the keys are too many for it, it lets all through."""
    keys = keys.toDF("key")
    bits = -(-min(max(64, 16 * keys.count()), FILTER_BITS) // 64) * 64
    words = written(bit_words(keys, 0, 2, bits), "filter").select("words").scalar()
    return has(words, key, 0, 2, bits)


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _components_of(docs, id_col, text_col)


def _components_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sketches = written(rows.mapInArrow(releasing(_sketches), "doc_id long, n long, f1 long, f2 long, sketch array<long>"), "sketches")
    named = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    # one set, one sketch: each class sends its sketch once
    classes = written(named.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    members = written(named.select("doc_id", "n", "f1", "f2").join(classes.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"]).select("doc_id", "rep"), "members")

    near = written(_sharing(classes.select("rep", "n", "sketch"), "sketch", SKETCH).select(F.col("rep").alias("doc_id")).distinct(), "near")
    sets = written(rows.filter(_likely(near, F.col("doc_id"))).join(near, "doc_id").dropDuplicates(["doc_id", "text"]).mapInArrow(releasing(_full_sets), "rep long, n long, tokens binary, wide array<long>"), "sets")
    linkable = written(_sharing(sets, "wide", WIDE_SKETCH), "linkable")
    sets = sets.select("rep", "n", "tokens")

    # groups of one key, linked inside and with the key's first chunk
    def packed(where: DataFrame, keys: list[str], name: str) -> DataFrame:
        """One row per group with its members (rep, comp, tokens)."""
        member = F.struct("rep", "comp", "tokens")
        return written(where.join(sets.drop("n"), "rep").groupBy(keys).agg(F.collect_list(member).alias("members")), name)

    keyed = written(_chunked(linkable.select("rep", "n", "key"), ["key"], "chunk"), "keyed")
    groups = packed(keyed.withColumn("comp", F.col("rep")), ["key", "chunk", "chunks"], "groups")
    inside = groups.filter(F.size("members") > 1).select("members").mapInArrow(releasing(_opened), "a long, b long")
    star = (groups.filter("chunk > 0").select("key", "members")
            .join(groups.filter("chunk = 0").select("key", F.col("members").alias("first")), "key")
            .select("members", "first").mapInArrow(releasing(_opened), "a long, b long"))
    links = written(inside.unionByName(star), "links")
    found = components(links, rounds=2)

    # the token-group matrix over groups that are of one component where a key is large
    comp = keyed.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    crowd = comp.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("crowd"))
    apart = F.when((F.col("chunks") > 1) & (F.col("crowd") >= APART), F.col("comp")).otherwise(-1)
    placed = _chunked(comp.join(crowd, ["key", "comp"]).select("rep", "n", "key", "comp", apart.alias("kind")), ["key", "kind"], "chunk")
    placed = written(placed.select("rep", "comp", F.xxhash64("key", "kind", "chunk").alias("g")), "placed")
    matrix = (linkable.select("rep", F.explode("prefix").alias("token")).join(placed, "rep").groupBy("token", "g")
              .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.collect_set("rep").alias("reps")))
    matrix = written(matrix, "matrix")
    one = matrix.select("token", F.col("g").alias("ga"), F.col("low").alias("la"), F.col("high").alias("ha"), F.col("reps").alias("left"))
    two = matrix.select("token", F.col("g").alias("gb"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.col("reps").alias("right"))
    # only the members that meet there are opened, at most a chunk of either group
    meet = (one.join(two, "token").filter("ga <= gb AND (la != ha OR lb != hb OR la != lb)").groupBy("ga", "gb")
            .agg(F.array_distinct(F.flatten(F.collect_set("left"))).alias("left"), F.array_distinct(F.flatten(F.collect_set("right"))).alias("right")))
    of = lambda side: F.transform(side, lambda r: F.struct(r.alias("rep"), F.lit(side).alias("side")))
    asked = meet.select("ga", "gb", F.explode(F.when(F.col("ga") == F.col("gb"), of("left")).otherwise(F.concat(of("left"), of("right")))).alias("m"))
    member = F.struct("rep", "comp", "tokens")
    opened = (asked.select("ga", "gb", "m.rep", "m.side").join(placed.select("rep", "comp").join(sets, "rep").select("rep", "comp", "tokens"), "rep").groupBy("ga", "gb")
              .agg(F.collect_list(F.when(F.col("side") == "left", member)).alias("left"), F.collect_list(F.when(F.col("side") == "right", member)).alias("right")))
    across = opened.select("left", F.when(F.col("ga") != F.col("gb"), F.col("right")).alias("right")).mapInArrow(releasing(_opened), "a long, b long")
    copies = members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.unionByName(written(across, "links")).unionByName(copies))
    return (sketches.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the least id; rows without an id stay; all columns as they are."""
    found = written(components_of(docs, id_col, text_col), "components")
    drop = written(found.filter("doc_id != component_id").select(F.col("doc_id").alias(id_col)).distinct(), "drop")
    likely = _likely(drop, F.col(id_col).cast("long"))
    # whole texts are shuffled only of rows that may go
    return docs.filter(~likely).unionByName(docs.filter(likely).join(drop, id_col, "left_anti").select(docs.columns))
