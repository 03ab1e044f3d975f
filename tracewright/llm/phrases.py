"""Phrase collocation mining by SON partitioning.

A phrase that reaches the support in the whole reaches, in at least one shard,
the share of the support that the shard has of the words. So every shard is
mined completely at that lowered support, level by level (a phrase can only be
frequent where both phrases of one word less are); the union of what is
frequent somewhere, less what its own local counts already rule out, is counted
in all shards exactly. A shard is a run of texts of one task, of bounded size.

Local counts travel as sorted, packed hashes of HASH bits, a few bytes a
phrase, and candidates in a Bloom filter of bounded size; a phrase that passes
is counted in every shard, by its text, so neither a collision nor a full
filter changes a count. These counts travel in blocks as well. With more shards than the support every phrase is frequent in its shard:
local counts are then complete and leave hardly a candidate too many, and the
work stays linear.

Defined results: null and empty texts have no words; a null language is `und`;
repeated rows count as often as they occur; an empty table has no phrases;
columns other than those named are not read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import written

MOST_WORDS, SUPPORT, TOP, SHARE, UNKNOWN = 5, 100, 2000, 100, "und"
#: Bytes of text of a shard, and the local support to keep while the tables are small.
SHARD_BYTES, LEAST_LOCAL = 24 << 20, 4
#: Bits of a packed hash, and local counts of all shards that one task merges at a time.
HASH, MERGED = 40, 1 << 20
#: Bits of the candidate filter at most (16 MB).
FILTER_BITS = 1 << 27
#: A-Z to small letters; marks and line ends to a line end, tabs to blanks.
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of about `limit` bytes, cut between pieces."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(b"\n", at + limit)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Shards of rows (text, lang): language and its normalised texts, one line per piece."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            for part in _parts((text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_LETTERS), limit):
                held.setdefault(lang.as_py() if lang.is_valid else UNKNOWN, []).append(part)
                size += len(part) + 1
                if size >= limit:
                    yield [(k, b"\n".join(v)) for k, v in held.items()]
                    held, size = {}, 0
    if held:
        yield [(k, b"\n".join(v)) for k, v in held.items()]


def _starts(text: bytes) -> np.ndarray:
    """Places of the first bytes of words."""
    points = np.frombuffer(text, np.uint8)
    first = (points != 10) & (points != 32)
    first[1:] &= ~first[:-1]
    return np.flatnonzero(first)


def count_words(text: bytes) -> int:
    return len(_starts(text))


def word_places(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a shard, the number of each word in order, and the number of the piece that each is in."""
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in part.split()), np.int32) for part in _parts(text, 1 << 20)]
    piece = np.cumsum(np.frombuffer(text, np.uint8) == 10, dtype=np.int32)[_starts(text)]
    return list(number), np.concatenate(ids), piece


def levels(text: bytes, lang: str, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = MOST_WORDS):
    """(k, hashes, counts, places, words, ids) of the kept phrases of each length: words[ids[place:place + k]] is the phrase.

    keep: hashes and counts of all phrases of a length whose parts of one word less were kept -> which to keep.
    """
    words, ids, piece = word_places(text)
    if not words:
        return
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    rank, counts = ids, np.bincount(ids, minlength=len(words))
    at = np.zeros(len(words), np.int64)
    at[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    hashes = _mixed(own + np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))))
    places = np.arange(len(ids), dtype=np.int32)  # where a phrase of this length starts
    for k in range(1, most + 1):
        if k > 1:
            held = np.full(len(ids) + 1, -1, np.int32)
            held[places] = rank
            go = (held[places + 1] >= 0) & (places + (k - 1) < len(ids))
            go[go] = piece[places[go]] == piece[places[go] + (k - 1)]
            places = places[go]
            key = held[places].astype(np.int64) * len(hashes) + held[places + 1]
            del held, go
            _, first, rank, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            at = places[first]
            hashes = _mixed(hashes[key[first] // len(hashes)] * _A + own[ids[at + (k - 1)]]) if len(at) else hashes[:0]
        chosen = keep(hashes, counts)
        yield k, hashes[chosen], counts[chosen], at[chosen], words, ids
        to = np.full(len(chosen), -1, np.int32)
        to[chosen] = np.arange(int(chosen.sum()), dtype=np.int32)
        rank = to[rank]
        places, rank = places[rank >= 0], rank[rank >= 0]
        hashes = hashes[chosen]
        if not len(places):
            return


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))


def word_counts(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """lang, n: the words of each shard."""
    def count(batches):
        for shard in shards(batches, limit):
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in shard], pa.string()), "n": pa.array([count_words(t) for _, t in shard], pa.int64())})
    return rows.mapInArrow(count, "lang string, n long")


def local_support(support: int, n: int, total: int) -> int:
    return max(1, -(-support * n // max(1, total)))


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32 with their low bytes first, so that bytes that are alike stand together."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def mined(rows: DataFrame, totals: dict[str, int], support: int, block_bits: int, limit: int = SHARD_BYTES, most: int = MOST_WORDS) -> DataFrame:
    """block, hashes, gains of every shard: sorted hashes of the phrases that are frequent in it, in steps, and for each
    count - (local support - 1). Blocks below 0 have a language's local support - 1."""
    low = HASH - block_bits

    def mine(batches):
        def row(blocks, hashes, gains, langs=None):
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(hashes, pa.binary()), pa.array(gains, pa.binary()),
                                               pa.array(langs or [None] * len(blocks), pa.string())], ["block", "hashes", "gains", "lang"])
        from pyspark import TaskContext
        own_block = -1 - TaskContext.get().partitionId() % 1024
        for shard in shards(batches, limit):
            for lang, text in shard:
                least = local_support(support, count_words(text), totals[lang])
                yield row([own_block], [b""], [_packed(np.array([least - 1]))], [lang])
                for _, hashes, counts, *_ in levels(text, lang, lambda h, c: c >= least, most):  # noqa: B023
                    short = (hashes >> np.uint64(64 - HASH)).astype(np.int64)
                    order = np.argsort(short)
                    short, gains = short[order], np.minimum(counts[order] - (least - 1), support)
                    block = short >> low
                    cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
                    own = short & ((1 << low) - 1)
                    parts = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                    for a in range(0, len(parts), 4096):
                        some = parts[a:a + 4096]
                        yield row([int(block[p.start]) for p in some], [_packed(np.diff(own[p], prepend=0)) for p in some], [_packed(gains[p]) for p in some])
    return rows.mapInArrow(mine, "block int, hashes binary, gains binary, lang string")


def candidates(local: DataFrame, slack: int, support: int, block_bits: int) -> DataFrame:
    """h: hashes whose gains and what shards that did not report them may add reach the support. Rows with h null: lang and a part of its slack."""
    low = HASH - block_bits

    def merge(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        gains = np.concatenate([_unpacked(x) for x in table.column("gains").to_pylist()])
        if block < 0:
            langs = table.column("lang").to_pylist()
            sums = Counter()
            for lang, gain in zip(langs, gains.tolist()):
                sums[lang] += gain
            return pa.table({"h": pa.nulls(len(sums), pa.int64()), "lang": pa.array(list(sums), pa.string()), "slack": pa.array(list(sums.values()), pa.int64())})
        hashes = np.concatenate([np.cumsum(_unpacked(x)) for x in table.column("hashes").to_pylist()])
        own, of = np.unique(hashes, return_inverse=True)
        chosen = np.bincount(of, gains) + slack >= support
        n = int(chosen.sum())
        return pa.table({"h": pa.array((block << low) + own[chosen], pa.int64()), "lang": pa.nulls(n, pa.string()), "slack": pa.nulls(n, pa.int64())})
    return local.groupBy("block").applyInArrow(merge, "h long, lang string, slack long")


def _bits(short: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    own = _mixed(short.astype(np.uint64) * _A)
    return own & np.uint64(size - 1), own >> np.uint64(32) & np.uint64(size - 1)


def candidate_filter(hashes: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of column h, as 64-bit words; its size is bounded, whatever the number of hashes."""
    n = hashes.count()
    size = 1 << min(most_bits.bit_length() - 1, max(10, (16 * max(1, n) - 1).bit_length()))

    def places(batches):
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy(zero_copy_only=False), size))
            word, place = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, place, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_pydict({"word": pa.array(word.astype(np.int64)), "bits": pa.array(bits.view(np.int64))})
    found = hashes.select("h").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size >> 6, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words.view(np.uint64)


def counted(rows: DataFrame, words_of_filter: np.ndarray, limit: int = SHARD_BYTES, most: int = MOST_WORDS, entries: int = 0) -> DataFrame:
    """lang, phrase (words joined by blanks), words, n: exact counts of all phrases that pass the filter.

    Shards send their counts in blocks by hash, a row for each block and length, not one for each phrase; a block is
    added up by the phrases themselves. entries: an upper bound of the counts of all shards, so that a task merges
    about MERGED of them at a time.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(words_of_filter)  # at most FILTER_BITS
    block_bits = min(24, max(8, (entries // MERGED).bit_length()))

    def count(batches):
        bloom = shared.value
        size = len(bloom) << 6
        one = np.uint64(1)

        def keep(hashes, _):
            a, b = _bits(hashes >> np.uint64(64 - HASH), size)
            return ((bloom[a >> np.uint64(6)] >> (a & np.uint64(63))) & (bloom[b >> np.uint64(6)] >> (b & np.uint64(63))) & one).astype(bool)
        for shard in shards(batches, limit):
            for lang, text in shard:
                for k, hashes, counts, at, words, ids in levels(text, lang, keep, most):
                    block = (hashes >> np.uint64(64 - block_bits)).astype(np.int64)
                    order = np.argsort(block, kind="stable")
                    block, counts, at = block[order], counts[order], at[order]
                    cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
                    parts = list(zip(cuts[:-1], cuts[1:]))
                    for i in range(0, len(parts), 64):
                        some = parts[i:i + 64]
                        # pieces end at line ends, so no phrase holds one
                        own = [b"\n".join([b" ".join([words[w] for w in p]) for p in ids[at[a:b, None] + np.arange(k)].tolist()]).decode("utf-8", "replace")
                               for a, b in some]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([int(block[a]) for a, _ in some], pa.int32()), pa.array([lang] * len(some), pa.string()),
                            pa.array(own, pa.string()), pa.array([_packed(counts[a:b]) for a, b in some], pa.binary())], ["block", "lang", "phrases", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        out = []
        for lang in dict.fromkeys(table.column("lang").to_pylist()):
            own = table.filter(pc.equal(table.column("lang"), lang))
            lists = [pc.split_pattern(c, "\n") for c in own.column("phrases").chunks]
            phrases = pa.chunked_array([x.flatten() for x in lists], pa.string()).combine_chunks().dictionary_encode()
            n = np.bincount(phrases.indices.to_numpy(), np.concatenate([_unpacked(x) for x in own.column("counts").to_pylist()]), len(phrases.dictionary))
            out.append(pa.table({"lang": pa.array([lang] * len(n), pa.string()), "phrase": phrases.dictionary,
                                 "words": pc.add(pc.count_substring(phrases.dictionary, " "), 1).cast(pa.int32()), "n": pa.array(n.astype(np.int64))}))
        return pa.concat_tables(out)
    return (rows.mapInArrow(count, "block int, lang string, phrases string, counts binary").groupBy("block")
            .applyInArrow(merge, "lang string, phrase string, words int, n long"))


def frequent(docs: DataFrame, support: int = SUPPORT, most: int = MOST_WORDS, text_col: str = "text", lang_col: str = "lang",
             shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, dict[str, int]]:
    """lang, phrase, words, n of all phrases of 1 to `most` words with n >= support, and the words of each language."""
    rows = _rows(docs, text_col, lang_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # few large shards while the support allows it; beyond that shards of a bounded size
    rows = rows.coalesce(max(1, support // LEAST_LOCAL, -(-size // shard_bytes)))
    own = written(word_counts(rows, shard_bytes), "phrases-words")
    of_langs = own.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()  # one row per language
    totals = {r.lang: r.n for r in of_langs}
    whole = F.sum("n").over(Window.partitionBy("lang"))
    least = F.greatest(F.lit(1), F.ceil(F.lit(support) * F.col("n") / F.greatest(whole, F.lit(1))))
    slack = own.withColumn("t", least).groupBy("lang").agg(F.sum(F.col("t")).alias("t"), F.count("*").alias("k")).agg(F.max(F.col("t") - F.col("k"))).first()[0] or 0
    bits = min(24, max(8, (sum(totals.values()) * most // MERGED).bit_length()))
    local = mined(rows, totals, support, bits, shard_bytes, most)
    found = written(candidates(local, slack, support, bits), "phrases-candidates")
    if (found.filter("h is null").groupBy("lang").agg(F.sum("slack").alias("slack")).agg(F.max("slack")).first()[0] or 0) > slack:
        # rows came in another order than before, and so did the shards: nothing may be ruled out
        found = written(candidates(local, support, support, bits), "phrases-candidates")
    hashes = found.filter("h is not null")
    bloom = candidate_filter(hashes)
    entries = hashes.count() * max((r.k for r in of_langs), default=0)  # a hash is of one language
    return written(counted(rows, bloom, shard_bytes, most, entries).filter(F.col("n") >= support), "phrases"), totals


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, share: int = SHARE, most: int = MOST_WORDS, text_col: str = "text",
                 lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's first `top` phrases by their lowest-scoring cut: lang, rank, phrase, a, l, r, n, score.

    A phrase goes where a longer frequent one holds it and has `share` percent of its count or more.
    """
    found, totals = frequent(docs, support, most, text_col, lang_col, shard_bytes)
    phrases = found.filter("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("n").alias("a"))
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    count = lambda side, name: found.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    sizes = docs.sparkSession.createDataFrame(list(totals.items()), "lang string, n long")
    wide = lambda c: F.col(c).cast("decimal(19,0)").cast("decimal(38,0)")
    cuts = cuts.join(F.broadcast(sizes), "lang").withColumns({"top": wide("a") * wide("n") * F.lit(1000), "low": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("top div low"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # contiguous parts of two words or more of every longer phrase
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("w") - m + 1), lambda s: F.array_join(F.slice("w", s, m), " "))))
    inside = (phrases.filter(F.size("w") > 2).select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score")))
