"""Exact dedup against a persistent digest index.

The index is a table of one row per distinct text, bucketed and sorted by
digest. New rows are reduced to one row per digest, sort-merge anti-joined with
the index (buckets meet buckets, the index is never shuffled) and the unknown
digests are appended.

Defined results: null text counts as empty; texts that are equal without white
space are copies; the row with the most code points, then the smallest doc_id
(null ids last) stays; rows that repeat a doc_id with an equal text stay or go
together; an empty table gives an empty result; other columns are left alone,
whatever their names.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import free_names, checkpoint_root, text_or_empty, written

#: Characters that do not count: space and the five controls from tab to return.
IGNORED = r"[\x20\x09-\x0D]+"
#: A digest with more rows than this share of all rows is joined by broadcast; there are fewer than 1 / share of them.
HOT_SHARE = 1 / 10_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, SHA-256 of the text without white space, code points of the text."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.regexp_replace(text, IGNORED, ""), 256)).alias("digest"),
                       F.char_length(text).cast("long").alias("chars"))


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays and the number of copies. Copies are reduced before the shuffle."""
    best = F.max(F.struct("chars", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus")))
    return (rows.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", (-F.col("b.minus")).alias("keep_id"), F.col("b.chars").alias("chars"), "group_size"))


class DigestIndex:
    """A bucketed table below `path`; opening a path again, with as many buckets, continues the index found there.

    Fewer buckets than the session's shuffle partitions would make Spark shuffle the index too.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{checkpoint_root(spark)}/{self.name}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, chars BIGINT, group_size BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, found: DataFrame) -> DataFrame:
        return found.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame) -> None:
        """Append digests; each bucket becomes one sorted file. Appending known digests again changes nothing."""
        fresh = self.unknown(new).select("digest", "keep_id", "chars", "group_size")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)


def add(index: DigestIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append the texts of `docs` to the index; one row per document: doc_id, digest, chars, keep_id, group_size, kept.

    group_size counts the rows of this call; keep_id is what the index holds, so a copy of an earlier text is dropped.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    found = groups(rows)
    index.append(found)
    total = rows.count()
    sizes = written(found.select("digest", "group_size"), "digest-sizes")
    known = sizes.join(index.read().select("digest", "keep_id"), "digest")
    hot_rows = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(known.filter(F.col("group_size") > hot_rows))
    tagged = rows.join(hot.withColumnRenamed("keep_id", "_keep").withColumnRenamed("group_size", "_size"), "digest", "left")
    is_hot = F.col("_size").isNotNull()
    by_broadcast = tagged.filter(is_hot).select("doc_id", "digest", "chars", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"))
    by_merge = (tagged.filter(~is_hot).drop("_keep", "_size")
                .join(known.filter(F.col("group_size") <= hot_rows), "digest").select("doc_id", "digest", "chars", "keep_id", "group_size"))
    return by_broadcast.unionByName(by_merge).withColumn("kept", F.expr("doc_id <=> keep_id"))


def keep_new(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text is neither in the index nor a lesser copy of another row; all columns as they are."""
    index = index or DigestIndex(docs.sparkSession)
    own_id, own_digest = free_names(docs, "_kept_id", "_kept_digest")
    kept = written(add(index, docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest)).distinct(), "kept")
    digest = F.unhex(F.sha2(F.regexp_replace(text_or_empty(text_col), IGNORED, ""), 256))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (digest == F.col(own_digest))
    return docs.join(kept, same, "left_semi")
