"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, filled, hash_words, slices, word_array, word_ids

#: Buckets of hashed features.
BITS = 18
#: Labelled rows that the fit takes at most: those with the smallest hash of their id.
MOST_LABELLED = 10_000
#: Passes of the fit over its rows, rows of a step, and the penalty on squared weights.
EPOCHS, BATCH, PENALTY = 30, 64, 3e-4
#: Buckets in fewer of the fitted rows keep weight 0: rare words say nothing about other texts.
LEAST_ROWS = 5
#: Length of a text's vector of values.
NORM = 5.0
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text: bucket, value, and where each text's start. A word gives itself (lower-cased,
    without punctuation at its ends) and, if it has any, that punctuation; a text gives the share of its words
    that are distinct, in tenths. A bucket's value is 1 + log of its count; the values of a text have length NORM."""
    words, first = word_array(texts)
    number, distinct = word_ids(words)
    plain = distinct.to_pylist()
    core = [w.strip(_PUNCT) for w in plain]
    rest = [w.replace(c, "\0", 1) if c else w for w, c in zip(plain, core)]
    mask = np.uint64((1 << BITS) - 1)
    a = (hash_words(pa.array([c.lower() for c in core], pa.string())) & mask).astype(np.int64)
    b = (hash_words(pa.array([f"\1{r}" for r in rest], pa.string())) & mask).astype(np.int64)
    has_a = np.fromiter(map(bool, core), bool, len(core))
    has_b = np.fromiter((r != "\0" for r in rest), bool, len(rest))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    x, y = has_a[number] if len(number) else np.empty(0, bool), has_b[number] if len(number) else np.empty(0, bool)
    own = np.unique(doc * max(1, len(core)) + number) // max(1, len(core)) if len(number) else doc
    full = np.flatnonzero(np.diff(first))
    tenth = 10 * np.bincount(own, minlength=len(texts))[full] // np.diff(first)[full]
    ratio = (hash_words(pa.array([f"\2{k}" for k in range(11)])) & mask).astype(np.int64)
    key = np.concatenate([(doc[x] << BITS) | a[number[x]], (doc[y] << BITS) | b[number[y]], (full << BITS) | ratio[tenth]])
    key, count = np.unique(key, return_counts=True)
    doc, value = key >> BITS, 1 + np.log(count)
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    norm = np.sqrt(np.bincount(doc, value**2, len(texts)))
    return key & ((1 << BITS) - 1), (NORM * value / norm[doc]).astype(np.float32), starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    """P(grade >= k) = sigmoid(w . x - t[k-1]) with one weight vector for all grades and ascending thresholds t."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, bucket: np.ndarray, value: np.ndarray, starts: np.ndarray, grade: np.ndarray, grades: int, seed: int = 7) -> Ordinal:
        """Adam on mini-batches of BATCH rows; thresholds are a first one and positive steps, so they stay in order."""
        r, w = np.random.default_rng(seed), np.zeros(1 << BITS)
        keep = np.bincount(bucket, minlength=1 << BITS)[bucket] >= LEAST_ROWS  # a bucket stands once in a row
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        bucket, value = bucket[keep], value[keep]
        share = np.bincount(grade, minlength=grades) / max(1, len(grade))
        tail = np.clip(np.cumsum(share[::-1])[::-1][1:], 1e-3, 1 - 1e-3)
        t = np.maximum.accumulate(-np.log(tail / (1 - tail)) + np.arange(grades - 1) * 1e-3)
        free = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
        m, v, fm, fv, step = np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free), 0
        for _ in range(EPOCHS if len(grade) else 0):
            order = r.permutation(len(grade))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                n = starts[rows + 1] - starts[rows]
                at = np.arange(n.sum()) + np.repeat(starts[rows] - (np.cumsum(n) - n), n)
                b, x, who = bucket[at], value[at], np.repeat(np.arange(len(rows)), n)
                z = np.bincount(who, w[b] * x, len(rows))
                t = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
                up = _sigmoid(z[:, None] - t[None, :])  # P(grade >= k), k = 1 ...
                full = np.concatenate([np.ones((len(rows), 1)), up, np.zeros((len(rows), 1))], axis=1)
                k, j = grade[rows], np.arange(len(rows))
                p = np.maximum(full[j, k] - full[j, k + 1], 1e-12)
                slope = full * (1 - full)
                c = np.full(len(rows), 1 / len(rows))
                dz = -c * (slope[j, k] - slope[j, k + 1]) / p
                dt = np.zeros((len(rows), grades + 1))
                dt[j, k] += c * slope[j, k] / p
                dt[j, k + 1] -= c * slope[j, k + 1] / p
                dt = dt[:, 1:-1].sum(axis=0)
                df = np.concatenate([[dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * np.exp(free[1:])])
                u, inv = np.unique(b, return_inverse=True)
                g = np.bincount(inv, dz[who] * x, len(u)) + PENALTY * w[u]
                step += 1
                rate = 0.05
                m[u] = 0.9 * m[u] + 0.1 * g
                v[u] = 0.99 * v[u] + 0.01 * g * g
                w[u] -= rate * m[u] / (np.sqrt(v[u] / (1 - 0.99**step)) + 1e-6)
                fm, fv = 0.9 * fm + 0.1 * df, 0.99 * fv + 0.01 * df * df
                free -= rate * fm / (np.sqrt(fv / (1 - 0.99**step)) + 1e-6)
        return cls(w.astype(np.float32), np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]))

    def tails(self, bucket: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each text."""
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        z = np.bincount(doc, self.weights[bucket] * value, len(starts) - 1)
        return _sigmoid(z[:, None] - self.thresholds[None, :])


def learn(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", most: int = MOST_LABELLED) -> Ordinal:
    """Fits on at most ``most`` ratings (id, grade): those with the smallest hash of their id, ties by id and grade.
    They are chosen before they meet the documents and broadcast, being bounded, so no text is shuffled; only
    features come to the driver. Ratings with null grade or one outside 0 ... grades - 1, and documents with null
    text, are left out; without any, every weight is 0."""

    def make(batches):
        for part in slices(batches, most=8 << 20):
            bucket, value, starts = features(filled(part.column("text")))
            at = pa.array(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("i").cast(pa.string()), part.column("grade"), pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value))],
                names=["i", "grade", "bucket", "value"],
            )

    own = ratings.where(F.col(grade_col).between(0, grades - 1)).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(id_col).alias("i"), F.col(grade_col).cast("int").alias("grade"))
    some = own.orderBy("h", "i", "grade").limit(most).select("i", "grade")
    met = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(some), "i")
    # the rows' order decides the steps of the fit
    got = met.select("i", "grade", "text").mapInArrow(make, "i string, grade int, bucket array<int>, value array<float>").toArrow().sort_by("i")
    grade = got.column("grade").combine_chunks().to_numpy().astype(np.int64)
    lists = [got.column(c).combine_chunks() for c in ("bucket", "value")]
    starts = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())]) if len(grade) else np.zeros(1, np.int64)
    bucket, value = (x.flatten().to_numpy() for x in lists)
    return Ordinal.fit(bucket, value, starts.astype(np.int64), grade, grades)


def rate(docs: DataFrame, model: Ordinal, keep_tail: int | None = None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Adds expected_grade, tails (P(grade >= k) for k = 1, 2, ...) and keep (P(grade >= keep_tail) >= least; by
    default the highest grade) to the columns of docs.

    Whole texts count. Null and empty texts have no features: their tails are those of the thresholds alone.
    Repeated rows are rated alike; an empty table gives none. Columns of docs with the new names are replaced.
    """
    k = keep_tail or len(model.thresholds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights of 4 bytes, whatever the corpus

    def judge(texts):
        tails = shared.value.tails(*features(texts))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1, dtype=np.int32) * tails.shape[1]), pa.array(tails.reshape(-1)))
        return [pa.array(tails.sum(axis=1)), lists, pa.array(tails[:, k - 1] >= least)]

    return beside(docs, text_col, [("expected_grade", "double"), ("tails", "array<double>"), ("keep", "boolean")], judge)
