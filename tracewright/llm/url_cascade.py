"""URL filter: host/path rules first, then exact list membership from a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the unlisted keys of the corpus that
level 1 lets through, level 3 the listed keys that level 2 lets through, and so
on until none is left. For every key of the universe it was built over the
answer is exact; a lookup is a chain of bit tests inside one expression.
Everything is a DataFrame expression.

Defined results: a null url or one without `://` has empty host and path and is
looked up as the empty key; repeated keys count once; an empty list or an empty
universe gives a filter that lists nothing.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the host or a parent of it and starts the path; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def bit_words(keys: DataFrame, level: int, hashes: int, bits: int) -> DataFrame:
    """One row: the bits of a Bloom filter as an array of longs."""
    at = F.explode(F.array(*_positions(F.col("key"), level, hashes, bits)))
    words = (keys.select(at.alias("p")).groupBy((F.shiftright("p", 6)).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")))
    every = keys.sparkSession.range(bits >> 6).withColumnRenamed("id", "w").join(words, "w", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")))),
                                 lambda x: x["v"]).alias("words"))


def has(words: Column, key: Column, level: int, hashes: int, bits: int) -> Column:
    tests = [F.expr("true")]
    for p in _positions(key, level, hashes, bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        tests.append(F.call_function("shiftrightunsigned", word, p.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


@dataclass
class Cascade:
    """levels: (hashes, bits) of each; words: a table of one row per level."""
    levels: list[tuple[int, int]]
    words: DataFrame | None

    @property
    def size_bytes(self) -> int:
        return sum(bits for _, bits in self.levels) // 8

    def listed(self, key: Column) -> Column:
        """Membership of a key of the universe; the filter reaches the tasks as a scalar subquery."""
        if not self.levels:
            return F.lit(False)
        words = self.words.agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "words"))), lambda x: x["words"]).alias("w")).select("w").scalar()
        # in at odd depth and out at the next: listed; the last level is exact
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            hashes, bits = self.levels[level - 1]
            out = F.when(has(F.get(words, F.lit(level - 1)), key, level, hashes, bits), out).otherwise(F.lit(level % 2 == 0))
        return out


def build(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> Cascade:
    """listed, universe: tables with a column `key`; listed keys outside the universe are encoded too."""
    inside = written(listed.select("key").filter("key is not null").distinct(), "cascade-listed")
    outside = written(universe.select("key").filter("key is not null").distinct().join(inside, "key", "left_anti"), "cascade-unlisted")
    n, s = inside.count(), outside.count()
    levels: list[tuple[int, int]] = []
    parts: DataFrame | None = None
    into, against, n_into, n_against = inside, outside, n, s
    while n_into:
        level = len(levels) + 1
        if level > max_levels:
            raise ValueError(f"the cascade did not end within {max_levels} levels")
        chance = min(0.5, n_into / (math.sqrt(2) * max(n_against, 1))) if level == 1 else 0.5
        hashes = max(1, round(math.log2(1 / chance)))
        bits = -(-max(64, math.ceil(n_into * hashes / math.log(2))) // 64) * 64
        one = written(bit_words(into, level, hashes, bits).select(F.lit(level).alias("level"), "words"), "cascade-level")
        levels.append((hashes, bits))
        parts = one if parts is None else parts.unionByName(one)
        passed = written(against.filter(has(one.select("words").scalar(), F.col("key"), level, hashes, bits)), "cascade-passed")
        into, against, n_into, n_against = passed, into, passed.count(), n_into
    return Cascade(levels, parts)


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], max_filter_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages` (page_id, url).

    The filter grows with the list, about 1.5 log2(unlisted / listed) bits a listed key; above `max_filter_bytes` the list
    is joined instead, with the same result.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    cascade = build(listed, parts.select(F.col("host").alias("key")))
    if cascade.size_bytes <= max_filter_bytes:
        marked = parts.withColumn("listed", cascade.listed(F.col("host")))
    else:
        keys = listed.select(F.col("key").alias("host")).distinct().withColumn("listed", F.lit(True))
        marked = parts.join(keys, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))


def hosts_with_labels(pages: DataFrame, labels: list[str]) -> DataFrame:
    """A list of keys drawn from the pages themselves: the hosts with one of the labels below their last."""
    host, _ = host_and_path(F.col("url"))
    split = F.split(host, r"\.")
    named = F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0)))
    return (pages.select(host.alias("key"), named.alias("labels"))
            .filter(F.arrays_overlap("labels", F.array(*map(F.lit, labels)))).select("key").distinct())
