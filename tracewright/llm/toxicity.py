"""Toxicity: a linear classifier with counterfactual regularisation.

Features of a text are its words and their beginnings (WORD_STARTS letters),
hashed into BUCKETS; the value is log(1 + occurrences). The classifier is fitted
on labelled documents. Beside their labels it sees counterfactuals: in labelled
texts every identity term is swapped for others of its group, the group's
neutral word among them, and the squared change of the score is a penalty. So a
term that merely occurs beside toxic words gets no weight of its own.

The classifier, its choice of buckets included, is fitted on LABELLED_ROWS
labelled documents at most, chosen by a hash of their id, so that texts are
never shuffled; scores cover all rows.

Defined results: null and empty texts are scored without features (the
intercept alone); letters other than A-Z count as letters, case is folded; a
document that is labelled more than once is toxic if any label says so, null
labels are none; repeated rows are scored alike; where not both labels occur the
score is the smoothed share of toxic ones (0 without labels); an empty table
gives an empty table; columns of the result replace none: a table that already
has them is refused by name.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from tracewright.llm.common import written
from tracewright.llm.tokens import slices

BUCKETS, WORD_STARTS = 1 << 19, (4, 5, 6, 7)
#: Buckets that get a weight, those that tell labels apart best, and the fewest toxic documents of one.
FEATURES, LEAST_DOCS = 8192, 3
#: Chi-square that such a bucket has at least: below it, one of BUCKETS has it by chance.
LEAST_GAIN = 25.0
#: Labelled documents that the weights are fitted on at most (the classifier's documented bound).
LABELLED_ROWS = 20_000
STEPS, RATE, L2, PENALTY = 600, 0.05, 1e-5, 1.0
THRESHOLD = 0.7
#: Cached words of a worker.
WORDS = 200_000

#: Groups of identity terms; the first of each is its neutral word (fixed values).
IDENTITY_GROUPS = (
    ("people", "women", "men", "girls", "boys", "immigrants", "refugees", "foreigners", "christians", "muslims", "jews", "hindus", "buddhists", "atheists",
     "catholics", "protestants", "gays", "lesbians", "blacks", "whites", "asians", "africans", "europeans", "americans", "mexicans", "arabs", "turks", "germans",
     "frenchmen", "spaniards"),
    ("person", "woman", "man", "girl", "boy", "immigrant", "refugee", "foreigner", "christian", "muslim", "jew", "hindu", "buddhist", "atheist", "catholic",
     "protestant", "lesbian"),
    ("human", "gay", "straight", "bisexual", "transgender", "queer", "black", "white", "asian", "african", "european", "american", "mexican", "arab", "turkish",
     "german", "french", "spanish", "jewish", "disabled", "deaf", "blind", "old", "young", "male", "female"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "türken", "franzosen"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "noirs", "blancs", "arabes"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "negros", "blancos", "árabes"),
)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    buckets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    intercept: float = 0.0
    share: float | None = None


class Features:
    """Bucket counts of texts; one object per task, its cache of words is bounded."""

    def __init__(self, limit: int = WORDS):
        self.known: dict[str, tuple[int, ...]] = {}
        self.limit = limit

    def of_word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            parts = ["=" + word, *(word[:k] for k in WORD_STARTS if len(word) > k)]
            got = self.known[word] = tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for p in parts)
        return got

    def of_words(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Buckets (ascending) and their counts."""
        at, n = [], []
        for word, count in words.items():
            own = self.of_word(word)
            at.extend(own)
            n.extend([count] * len(own))
        bucket, place = np.unique(np.array(at, np.int64), return_inverse=True)
        return bucket, np.bincount(place, n, len(bucket)) if len(bucket) else np.empty(0)


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def swapped(words: Counter, groups, shift: int) -> Counter | None:
    """Words with every identity term replaced: by its group's neutral word (shift 0) or the `shift`-th next term. None without one."""
    out, changed = Counter(words), False
    for group in groups:
        for i, term in enumerate(group):
            if words.get(term):
                to = group[0] if shift == 0 else group[(i + shift) % len(group)]
                out[term] -= words[term]
                out[to] += words[term]
                changed |= to != term
    return +out if changed else None


def labelled_documents(docs: DataFrame, labels: DataFrame, chosen: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                        most: int = LABELLED_ROWS) -> DataFrame:
    """text, toxic (0 or 1) of the chosen documents with a label, those of `most` labelled ids at most."""
    known = written(labels.filter(chosen).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic"))
                    .filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
    share = min(1.0, 0.97 * most / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(most)
    rows = docs.filter(chosen).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(picked), "id").select("text", "toxic")


def bucket_counts(labelled: DataFrame) -> DataFrame:
    """bucket, toxic, docs: documents that hold the bucket, and how many of them are toxic; bucket -1 is all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, toxic, docs = Features(), np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                own = features.of_words(words_of(text.as_py()))[0]
                docs[own] += 1
                docs[-1] += 1
                if label:
                    toxic[own] += 1
                    toxic[-1] += 1
        found = np.flatnonzero(docs)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.where(found == BUCKETS, -1, found), pa.int32()),
                                          "toxic": pa.array(toxic[found].astype(np.int32), pa.int32()), "docs": pa.array(docs[found].astype(np.int32), pa.int32())})
    return labelled.mapInArrow(count, "bucket int, toxic int, docs int").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))


def _vectors(labelled: DataFrame, buckets: np.ndarray, groups) -> DataFrame:
    """kind (0: document, 1: counterfactual change), label, at, values: sparse rows over the chosen buckets."""
    def run(batches):
        features = Features()
        place = np.full(BUCKETS, -1, np.int64)
        place[buckets] = np.arange(len(buckets))

        def sparse(words):
            bucket, n = features.of_words(words)
            own = place[bucket]
            return own[own >= 0], np.log1p(n[own >= 0])
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_of(text.as_py())
                at, values = sparse(words)
                out.append((0, label, at, values))
                for shift in (0, 1, 5):
                    other = swapped(words, groups, shift)
                    if other is not None:
                        at2, values2 = sparse(other)
                        both, of = np.unique(np.concatenate([at2, at]), return_inverse=True)
                        change = np.bincount(of, np.concatenate([values2, -values]), len(both)) if len(both) else values
                        moved = change != 0
                        out.append((1, label, both[moved], change[moved]))
            kind, label, at, values = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(label, pa.int32()), pa.array(at, pa.list_(pa.int64())),
                                              pa.array(values, pa.list_(pa.float64()))], ["kind", "label", "at", "values"])
    return labelled.mapInArrow(run, "kind int, label int, at array<bigint>, values array<double>")


def _minimum(rows, changes, labels: np.ndarray, d: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept with the least mean log loss + L2 + penalty * mean squared score change; Adam over all rows."""
    (r, c, v), (r2, c2, v2, n2) = rows, changes
    n, w, m, s = len(labels), np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    share = labels.mean()
    w[-1] = np.log(share / (1 - share))
    for t in range(1, STEPS + 1):
        z = np.bincount(r, v * w[c], n) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
        grad = np.append(np.bincount(c, v * e[r], d) + L2 * w[:-1], e.sum())
        if n2 and penalty:
            change = np.bincount(r2, v2 * w[c2], n2)
            grad[:-1] += 2 * penalty / n2 * np.bincount(c2, v2 * change[r2], d)
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        w = w - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, penalty: float = PENALTY, groups=IDENTITY_GROUPS) -> Model:
    """A model from text, toxic, a bounded number of rows. What reaches the driver: FEATURES counts and the rows' sparse features."""
    labelled = written(labelled, "toxicity-labelled")
    counts = written(bucket_counts(labelled), "toxicity-buckets")
    whole = counts.filter("bucket = -1").first()
    if whole is None:
        return Model()
    n, p = whole.docs, whole.toxic
    share = (p + 0.5) / (n + 1)
    if p in (0, n):
        return Model(share=share)
    own, toxic = F.col("docs").cast("double"), F.col("toxic").cast("double")
    expected = own * (p / n)
    gain = (toxic - expected) ** 2 / (expected * (1 - p / n) * (1.000001 - own / n))
    named = sorted({zlib.crc32(("=" + t).encode()) & (BUCKETS - 1) for g in groups for t in g})  # so that a term's weight can be held down
    best = (counts.filter((F.col("bucket") >= 0) & (toxic > expected) & (F.col("toxic") >= LEAST_DOCS) & (gain >= LEAST_GAIN))
            .orderBy(gain.desc(), "bucket").limit(FEATURES).select("bucket").collect())
    seen = counts.filter(F.col("bucket").isin(named)).select("bucket").collect()
    buckets = np.array(sorted({r.bucket for r in best} | {r.bucket for r in seen}), np.int64)
    if not len(buckets):
        return Model(share=share)
    found = _vectors(labelled, buckets, groups).toArrow()
    kind, label = found.column("kind").to_numpy(), found.column("label").to_numpy()

    def flat(chosen):
        part = found.filter(pa.array(chosen))
        at, values = part.column("at").combine_chunks(), part.column("values").combine_chunks()
        sizes = np.array([len(x) for x in at]) if len(at) else np.empty(0, np.int64)
        return np.repeat(np.arange(len(sizes)), sizes.astype(np.int64)), at.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False), len(sizes)
    r, c, v, _ = flat(kind == 0)
    own_labels = label[kind == 0].astype(float)
    if not 0 < own_labels.sum() < len(own_labels):
        return Model(share=share)
    weights, intercept = _minimum((r, c, v), flat(kind == 1), own_labels, len(buckets), penalty)
    return Model(buckets, weights, intercept, share)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Adds the score (0 to 1) and 1 where it is THRESHOLD or more, else 0; the other columns pass through."""
    taken = {score_col.lower(), predicted_col.lower()} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"the table already has {sorted(taken)}; name other result columns")
    at = docs.columns.index(text_col)

    def run(batches):
        features = Features()
        weight = np.zeros(BUCKETS)
        weight[model.buckets] = model.weights
        for batch in batches:
            texts = batch.column(at)
            for a, b in slices([t.as_py() or "" for t in texts]):
                out = np.full(b - a, 0.0 if model.share is None else model.share)
                for i in range(a, b) if len(model.weights) else ():
                    bucket, n = features.of_words(words_of(texts[i].as_py()))
                    z = float(weight[bucket] @ np.log1p(n)) + model.intercept
                    out[i - a] = 1 / (1 + np.exp(-min(40.0, max(-40.0, z))))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64()), pa.array((out >= THRESHOLD).astype(np.int32), pa.int32())],
                                                 [*part.schema.names, score_col, predicted_col])
    schema = StructType(list(docs.schema.fields)).add(score_col, DoubleType()).add(predicted_col, IntegerType())
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
