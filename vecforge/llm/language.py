"""Language identification by a byte convolutional network.

Texts are cut into fixed-length byte windows that cover them wholly. Filters of several widths run over each window's
bytes (a table row for each byte and place in the filter), are pooled by their maximum and lead to a softmax. A
document's class is that of its windows' mean log probabilities, weighted by their bytes. The network is trained in
numpy on windows of a bounded sample of labelled rows.

Defined cases: a null text, or one without a letter, is `und` with score 0. Without any labelled row all are `und`.
Equal texts get equal results; lang, source and doc_id are no input of a prediction. Other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, crc_mod, table, text_buffer

#: Bytes of a window, filter widths and filters of each width.
LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4), 12
#: Bound of the training sample: rows, and windows that a row gives.
SAMPLE_ROWS, ROW_WINDOWS = 4000, 3
STEPS, BATCH, RATE = 500, 128, 0.02
#: Windows that one vectorised step holds.
GROUP = 512


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]  # for each width: place, byte, filter
    bias: np.ndarray
    weight: np.ndarray
    weight_bias: np.ndarray

    def paired(self) -> list[list[np.ndarray]]:
        """For each width, tables by two bytes at once (65,536 rows) and, for an odd width, by the last byte."""
        out = []
        for t in self.tables:
            pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(t) - 1, 2)]
            out.append(pairs + ([t[-1]] if len(t) % 2 else []))
        return out

    def log_probs(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.weight + self.weight_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def pooled(x: np.ndarray, paired: list[list[np.ndarray]]) -> np.ndarray:
    """Largest response of each filter over x, whose rows are byte places and whose columns are windows."""
    length, n = x.shape
    one = x.astype(np.int32)
    two = one[:-1] * 256 + one[1:]
    out = []
    for width, tables in zip(WIDTHS, paired, strict=True):
        best = None
        for t in range(length - width + 1):
            y = tables[0].take(two[t], axis=0)
            for k, more in enumerate(tables[1:], 1):
                y += more.take(two[t + 2 * k] if len(more) == 65536 else one[t + 2 * k], axis=0)
            best = y if best is None else np.maximum(best, y, out=best)
        out.append(best)
    return np.concatenate(out, axis=1) if n else np.zeros((0, FILTERS * len(WIDTHS)), np.float32)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7) -> Network:
    """Adam on cross entropy; gradients pass a pooled maximum to the place that gave it."""
    rng = np.random.default_rng(seed)
    f = FILTERS
    params = [rng.normal(0, 0.3, (w, 256, f)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(f * len(WIDTHS), np.float32), rng.normal(0, 0.2, (f * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.bincount(labels, minlength=len(langs)).astype(float)
    odds = (1 / np.maximum(share, 1))[labels] ** 0.5
    odds /= odds.sum()
    for step in range(1, STEPS + 1):
        pick = rng.choice(len(windows), BATCH, p=odds)
        x = windows[pick].copy()
        keep = rng.choice((12, 24, 64, LENGTH, LENGTH), BATCH)  # short texts occur too
        x[np.arange(LENGTH)[None, :] >= keep[:, None]] = 0
        tops, places = [], []
        for w, t in zip(WIDTHS, params, strict=False):
            span = LENGTH - w + 1
            y = sum(t[k].take(x[:, k : k + span], axis=0) for k in range(w))
            place = y.argmax(axis=1)
            places.append(place)
            tops.append(np.take_along_axis(y, place[:, None, :], axis=1)[:, 0])
        net = Network(langs, params[: len(WIDTHS)], *params[len(WIDTHS) :])
        top = np.concatenate(tops, axis=1)
        hidden = np.maximum(top + net.bias, 0)
        delta = np.exp(net.log_probs(top))
        delta[np.arange(BATCH), labels[pick]] -= 1
        delta /= BATCH
        back = (delta @ net.weight.T) * (hidden > 0)
        grads: list[np.ndarray] = []
        for i, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
            g = back[:, i * f : (i + 1) * f]
            grad = np.zeros((w, 256 * f), np.float32)
            for k in range(w):
                byte = np.take_along_axis(x, place + k, axis=1).astype(np.int64)
                grad[k] = np.bincount((byte * f + np.arange(f)).ravel(), g.ravel(), 256 * f)
            grads.append(grad.reshape(w, 256, f))
        grads += [back.sum(axis=0), hidden.T @ delta + 1e-4 * net.weight, delta.sum(axis=0)]
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(langs, params[: len(WIDTHS)], *params[len(WIDTHS) :])


def last_chosen(hashes: DataFrame, rows: int) -> int | None:
    """The greatest of so many least distinct 64-bit hashes h, or of all; copies of a text count once."""
    share = 4 * rows / max(1, hashes.agg(F.approx_count_distinct("h")).first()[0])
    while True:
        # A filter bounds what is sorted; where it leaves too few, it is widened.
        part = hashes.where(F.col("h") < int(-(1 << 63) + (1 << 64) * share)) if share < 1 else hashes
        found, last = part.distinct().orderBy("h").limit(rows).agg(F.count("*"), F.max("h")).first()
        if found >= rows or share >= 1:
            return last
        share *= 4


def sample_windows(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, list[str]]:
    """At most ROW_WINDOWS windows, spread over the whole text, of each of at most so many rows, chosen by a hash."""
    usable = labelled.where("text is not null and lang is not null and text <> ''").select("text", "lang", F.xxhash64("text", F.lit(11)).alias("h"))
    # Only hashes are sorted, of a few times the rows wanted; then the texts up to the last one chosen are taken, one row of each.
    last = last_chosen(usable.select("h"), rows)
    if last is None:
        return np.zeros((0, LENGTH), np.uint8), []
    chosen = usable.where(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            out, langs = [], []
            for i, lang in enumerate(batch.column(1).to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                n = min(ROW_WINDOWS, -(-(b - a) // LENGTH))
                for j in range(n):
                    at = a + (max(0, b - a - LENGTH) * j // max(1, n - 1) if n > 1 else 0)
                    out.append(data[at : min(b, at + LENGTH)].tobytes().ljust(LENGTH, b"\0"))
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(langs, pa.string())], ["window", "lang"])

    got = chosen.select("text", "lang").mapInArrow(run, "window binary, lang string").toArrow()
    order_ = sorted(zip(got.column(1).to_pylist(), got.column(0).to_pylist(), strict=True))
    return np.frombuffer(b"".join(w for _, w in order_), np.uint8).reshape(-1, LENGTH), [x for x, _ in order_]


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """A network from a bounded sample of text and lang; None without labelled rows."""
    windows, names = sample_windows(labelled, rows)
    if not names:
        return None
    langs = sorted(set(names))
    return train(windows, np.searchsorted(langs, names), langs)


def predict(documents: DataFrame, network: Network | None) -> DataFrame:
    """All rows and columns, with lang_pred and score; names that clash are replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(vars(network) if network else None)
    ids = [c for c in documents.columns if c not in ("lang_pred", "score")]
    frame = documents.select(*ids)
    schema = StructType(list(frame.schema.fields)).add("lang_pred", "string").add("score", "double")
    text_at = ids.index("text")

    def run(batches):
        # Plain arrays travel; an executor need not have this module.
        net = Network(**shared.value) if shared.value else None
        paired = net.paired() if net else []
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_at))
            n = len(offsets) - 1
            langs: list[str] = ["und"] * n
            scores = np.zeros(n)
            for a, b in chunks(offsets) if net else ():
                rows, sums = [], np.zeros((b - a, len(net.langs)))
                for i in range(a, b):
                    o, e = int(offsets[i]), int(offsets[i + 1])
                    if has_letter(data[o:e]):
                        rows.extend((i - a, at, min(LENGTH, e - at)) for at in range(o, e, LENGTH))
                for g in range(0, len(rows), GROUP):
                    part = rows[g : g + GROUP]
                    x = np.zeros((len(part), LENGTH), np.uint8)
                    for k, (_, at, size) in enumerate(part):
                        x[k, :size] = data[at : at + size]
                    logs = net.log_probs(pooled(np.ascontiguousarray(x.T), paired))
                    np.add.at(sums, [r[0] for r in part], logs * np.array([[r[2]] for r in part]))
                for i in sorted({r[0] for r in rows}):
                    mean = sums[i] / (offsets[a + i + 1] - offsets[a + i])
                    p = np.exp(mean - mean.max())
                    langs[a + i], scores[a + i] = net.langs[int(p.argmax())], float(p.max() / p.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*ids, "lang_pred", "score"])

    return frame.mapInArrow(run, schema)


def has_letter(data: np.ndarray) -> bool:
    low = data | 32
    return bool(((low >= 97) & (low <= 122) & (data < 128)).any()) or (bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode()))


def identify(documents: DataFrame, labelled: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
    """The documents whose language is told with min_score at least, with all their columns."""
    network = fit(documents if labelled is None else labelled)
    # Columns of the input that share a name with the prediction's keep their own values.
    clash = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in documents.columns}
    out = predict(documents.withColumnsRenamed(clash), network)
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).drop("lang_pred", "score")
    return out.withColumnsRenamed({v: k for k, v in clash.items()}).select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    network = fit(docs.where(crc_mod("doc_id", 3) != 1).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), network)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
