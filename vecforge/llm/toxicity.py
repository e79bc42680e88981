"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct words, lower-cased and hashed to buckets. The score is the logistic of a bias, a
weight for each bucket, and the pairwise interactions of the buckets' factor vectors, in linear time by the identity
sum over pairs = half of (square of the sum - sum of the squares). Buckets that tell nothing of the label in the training
sample are left out, so that a long harmless text adds no noise: those stay whose own rate of toxic rows differs
significantly, and those of pairs whose common rate differs significantly from what both alone add up to. For the pairs,
PAIR_TERMS buckets are counted against each other, half of them those of greatest difference, half the most frequent.

Defined cases: null and empty texts have no features and get the bias alone. Without labelled rows every score is the
smoothed prior. Labels that are null don't count; repeated rows count as often as they occur. Clashing columns are
left out before the join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, chunks, crc_mod, table, text_buffer, thinned, words

#: Bits of a bucket, length of the factor vectors.
BITS, FACTORS = 20, 6
#: Bound of the training sample in labelled rows.
SAMPLE_ROWS = 12_000
#: Least standard deviations by which a term's rate of toxic rows must differ, and least rows that have it.
LEAST_Z, LEAST_ROWS = 5.0, 4
#: The same for pairs, of which there are a thousand times as many.
PAIR_Z, PAIR_ROWS = 10.0, 20
#: Buckets whose pairs are counted.
PAIR_TERMS = 1500
#: Steps of training, their rate, the decay of weights and factors (on the mean loss of a row), spread of the first factors.
STEPS, RATE, DECAY, SPREAD = 250, 0.1, 1e-6, 0.1


@dataclass
class Machine:
    bias: float
    place: np.ndarray  # bucket -> feature, -1 if it is none
    weight: np.ndarray
    factors: np.ndarray

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weight[feature], rows)
        v = self.factors[feature]
        for k in range(FACTORS):
            z += 0.5 * (np.bincount(row, v[:, k], rows) ** 2 - np.bincount(row, v[:, k] ** 2, rows))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word of the rows between the offsets."""
    _, _, h, first = words(data, offsets, ALNUM)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), (h >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << BITS) | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def of_pairs(row: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, held: np.ndarray, z: np.ndarray, prior: float) -> np.ndarray:
    """Buckets of the pairs whose rate of toxic rows isn't the sum of both buckets' own, on the scale of log odds."""
    usable = np.flatnonzero((held >= 2 * LEAST_ROWS) & (held <= len(toxic) - LEAST_ROWS))
    strong = usable[np.argsort(-np.abs(z[usable]), kind="stable")[: PAIR_TERMS // 2]]
    among = np.union1d(strong, usable[np.argsort(-held[usable], kind="stable")[: PAIR_TERMS // 2]])
    if len(among) < 2:
        return among[:0]
    column = np.full(1 << BITS, -1, np.int64)
    column[among] = np.arange(len(among))
    has = column[bucket] >= 0
    x = np.zeros((len(toxic), len(among)), np.float32)
    x[row[has], column[bucket[has]]] = 1
    both, hits = x.T @ x, (x * toxic[:, None].astype(np.float32)).T @ x
    own = logit((np.diag(hits) + prior) / (np.diag(both) + 1))
    expected = 1 / (1 + np.exp(-np.clip(own[:, None] + own[None, :] - logit(np.array(prior)), -8, 8)))
    gap = (hits - both * expected) / np.sqrt(np.maximum(both * expected * (1 - expected), 0.25))
    np.fill_diagonal(gap, 0)
    return among[((both >= PAIR_ROWS) & (np.abs(gap) >= PAIR_Z)).any(axis=1)]


def train(row: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, seed: int = 3) -> Machine:
    """Selects the buckets, then fits the machine by Adam on the whole sample."""
    n, positives = len(toxic), float(toxic.sum())
    prior = (positives + 0.5) / (n + 2)
    place = np.full(1 << BITS, -1, np.int64)
    empty = Machine(float(np.log(prior / (1 - prior))), place, np.zeros(0), np.zeros((0, FACTORS)))
    if not n or positives in (0, n):
        return empty
    held = np.bincount(bucket, minlength=1 << BITS)
    hits = np.bincount(bucket, toxic[row], 1 << BITS)
    z = (hits - held * prior) / np.sqrt(np.maximum(held * prior * (1 - prior), 1e-9))
    alone = np.flatnonzero((held >= LEAST_ROWS) & (np.abs(z) >= LEAST_Z))
    chosen = np.union1d(alone, of_pairs(row, bucket, toxic, held, z, prior))
    if not len(chosen):
        return empty
    place[chosen] = np.arange(len(chosen))
    feature = place[bucket]
    row, feature = row[feature >= 0], feature[feature >= 0]
    rng = np.random.default_rng(seed)
    params = [np.array([empty.bias]), np.zeros(len(chosen)), rng.normal(0, SPREAD, (len(chosen), FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        bias, weight, factors = params
        p = Machine(float(bias[0]), place, weight, factors).scores(row, feature, n)
        delta = (p - toxic) / n
        d = delta[row]
        total = np.stack([np.bincount(row, factors[feature, k], n) for k in range(FACTORS)], axis=1)
        pull = d[:, None] * (total[row] - factors[feature])
        grads = [np.array([delta.sum()]), np.bincount(feature, d, len(chosen)) + DECAY * weight, np.stack([np.bincount(feature, pull[:, k], len(chosen)) for k in range(FACTORS)], axis=1) + DECAY * factors]
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Machine(float(params[0][0]), place, params[1], params[2])


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from a bounded sample, chosen by a hash, of the labelled rows."""
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    # The sample's bound makes this side small enough to broadcast.
    usable = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("double").alias("toxic"), order.alias("h"))
    sample = thinned(usable, F.col("h"), 2 * rows).orderBy("h", "doc_id", "toxic").limit(rows).select("doc_id", "toxic")
    joined = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            out = []
            for a, b in chunks(offsets):
                row, bucket = distinct(*terms(data, offsets[a : b + 1]))
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                out.extend(bucket[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(b - a))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["buckets", "toxic"])

    got = joined.mapInArrow(run, "buckets binary, toxic double").toArrow()
    pairs = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    sets = [np.frombuffer(x, np.int32).astype(np.int64) for x, _ in pairs]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) if sets else np.empty(0, np.int64)
    return train(row, np.concatenate(sets) if sets else np.empty(0, np.int64), np.array([t for _, t in pairs], float))


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(vars(machine))

    def run(batches):
        m = Machine(**shared.value)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out = []
            for a, b in chunks(offsets):
                row, bucket = terms(data, offsets[a : b + 1])
                used = m.place[bucket] >= 0
                row, bucket = distinct(row[used], bucket[used])
                out.append(m.scores(row, m.place[bucket], b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
