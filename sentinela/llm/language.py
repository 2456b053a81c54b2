"""Language ID (operator 2): averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the average of the embeddings of its byte 2-, 3- and 4-grams (A-Z lower-cased; digits, ASCII
punctuation and white space become one blank), hashed to ``BUCKETS`` rows; a linear softmax on that average is
trained with it by stochastic gradient descent in numpy. The fit uses at most ``SAMPLE`` labelled rows, the first
by a hash of the id, each with its whole text; a fifth of them is kept back to calibrate. A temperature makes the scores
probabilities (labels are smoothed by the error rate, so that it is finite when all are right). A text is rejected if its
score is low (at most a share of ``REJECT`` of correctly labelled texts is), or if it does not look like the language that
it is given: its n-grams' mean log share in that language's training texts lies further below the median than ``FAR``
times the distance of the first percentile. Prediction reads every whole text; embedding, softmax and log shares are one
table there, because all are linear.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; without labelled
rows everything is; a null id counts as seen; repeated rows are predicted each; an empty table gives no rows; columns
named lang_pred, lang_score or lang_rejected are replaced, all others pass.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela.llm import common as C
from sentinela.llm import kernels as K

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
DIMENSION = 16
SAMPLE = 3_000
EPOCHS = 8
RATE = 0.5
REJECT = 0.002
#: How far below the median a text's mean log share may lie, in distances of the first percentile (of ``NEAREST`` at least).
FAR, NEAREST = 8.0, 0.3
FOLD = K.LOWER.copy()
FOLD[:128] = np.where(np.array([chr(c).isalpha() for c in range(128)]), K.LOWER[:128], 32)


def buckets_of(data: np.ndarray) -> list[np.ndarray]:
    """For each n-gram size the bucket of the n-gram that starts at each byte (those over the end wrap to blanks)."""
    x = np.concatenate([FOLD[data], np.full(4, 32, np.uint8)]).astype(np.uint32)
    out, n = [], len(data)
    gram = x[:n].copy()
    for k in range(1, max(SIZES)):
        gram = gram << np.uint32(8) | x[k : k + n]
        if k + 1 in SIZES:
            h = (gram + np.uint32(k)) * np.uint32(2654435761)
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - 15)).astype(np.int32))
    return out


def counts_of(data: np.ndarray) -> tuple[bytes, bytes]:
    """The buckets of one text and how often each occurs, in one or four bytes."""
    ids, n = np.unique(np.concatenate(buckets_of(data)), return_counts=True)
    return ids.astype(np.uint16).tobytes(), n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32).tobytes()


def shares_of(ids: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text and their shares."""
    own = np.frombuffer(ids, np.uint16)
    n = np.frombuffer(counts, np.uint8 if len(counts) == len(own) else np.uint32)
    return own, (n / max(1, n.sum())).astype(np.float32)


class Model(NamedTuple):
    """Languages, the joint table (bucket, language), bias, temperature and threshold of the score; log shares (bucket,
    language) and for each language the limit of their mean."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    shares: np.ndarray
    limits: np.ndarray


def logits(table: np.ndarray, bias: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row per text; an empty text has the bias alone."""
    out = np.tile(bias, (len(offs) - 1, 1)).astype(np.float64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        own = np.arange(len(data)) + 4 * np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        apart = np.full(len(data) + 4 * (len(offs) - 1), 32, np.uint8)  # blanks after each text: no n-gram reaches the next
        apart[own] = data
        grams = [g[own] for g in buckets_of(apart)]
        for at in range(table.shape[1]):
            column = np.ascontiguousarray(table[:, at])
            each = column[grams[0]]
            for g in grams[1:]:
                each += column[g]
            out[full, at] += np.add.reduceat(each, offs[full], dtype=np.float64) / (np.diff(offs)[full] * len(SIZES))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[bytes, bytes]], labels: list[str], seed: int = 1) -> Model:
    """Train on (buckets, counts) of texts and their labels."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.RandomState(seed)
    n, m = len(rows), len(languages)
    embedding = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    weight, bias = np.zeros((DIMENSION, m), np.float32), np.zeros(m, np.float32)
    order = rng.permutation(n)
    apart, train = order[: n // 5], order[n // 5 :]
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            ids, share = shares_of(*rows[i])
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ embedding[ids]
            error = softmax(hidden @ weight + bias)
            error[y[i]] -= 1
            back = weight @ error
            weight -= rate * np.outer(hidden, error)
            bias -= rate * error * 0.1
            embedding[ids] -= (rate * len(ids) ** 0.5) * share[:, None] * back[None, :]
    share = np.zeros((BUCKETS, m))
    for i in train:
        ids, own = shares_of(*rows[i])
        share[ids, y[i]] += own
    share /= np.maximum(1, np.bincount(y[train], minlength=m))
    table, shares = (embedding @ weight).astype(np.float32), np.log(share + 1e-6).astype(np.float32)
    held = apart if len(apart) else train
    z = np.array([own @ table[ids] + bias for ids, own in (shares_of(*rows[i]) for i in held)])
    looks = np.array([own @ shares[ids, y[i]] for i, (ids, own) in ((i, shares_of(*rows[i])) for i in held)])
    wrong = (1 + (z.argmax(1) != y[held]).sum()) / (2 + len(held))
    target = np.full((len(held), m), wrong / max(1, m - 1))
    target[np.arange(len(held)), y[held]] = 1 - wrong if m > 1 else 1.0
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.005, 50, 120):
        loss = -(target * np.log(np.maximum(softmax(z / t), 1e-12))).sum(axis=1).mean()
        if loss < best:
            best, temperature = loss, float(t)
    right = softmax(z / temperature)[np.arange(len(held)), y[held]]
    threshold = float(min(0.5, np.quantile(right, REJECT)))
    middle = [np.quantile(looks[y[held] == k] if (y[held] == k).any() else looks, [0.01, 0.5]) for k in range(m)]
    limits = np.array([mid - FAR * max(mid - low, NEAREST) for low, mid in middle])
    return Model(languages, table, bias, temperature, threshold, shares, limits)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on the first ``sample`` rows of (doc_id, text, lang) by a hash of the id; None if there are none."""

    def run(batches):
        for batch in batches:
            data, offs = K.flat(batch.column(1))
            ids, counts = zip(*(counts_of(data[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "ids", "counts"])

    usable = labelled.filter("lang is not null and length(text) > 0")
    keys = usable.select(F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t")).distinct()
    keys = F.broadcast(keys.orderBy("_h", "_t").limit(sample))  # at most ``sample`` pairs of hashes
    first = usable.withColumns({"_h": F.xxhash64("doc_id"), "_t": F.xxhash64("text")}).join(keys, ["_h", "_t"]).dropDuplicates(["_h", "_t"])
    got = first.select("lang", "text").mapInArrow(run, "lang string, ids binary, counts binary").toArrow()  # at most ``sample`` rows
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("lang", "ids", "counts")), strict=True))
    del got
    return fit([r[1:] for r in rows], [r[0] for r in rows]) if rows else None


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    low = K.LOWER[data]
    out, full = np.zeros(len(offs) - 1, bool), np.flatnonzero(np.diff(offs))
    if len(full):
        out[full] = np.logical_or.reduceat((low >= 97) & (low <= 122), offs[full])
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)).tolist():
        raw = data[offs[i] : offs[i + 1]]
        if (raw >= 128).any():
            out[i] = any(c.isalpha() for c in raw.tobytes().decode(errors="replace"))
    return out


def predict(docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all unless given) with lang_pred, lang_score and lang_rejected of its ``text``."""
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    columns = docs.columns if columns is None else columns
    whole = columns if "text" in columns and docs.schema["text"].dataType == T.StringType() else ["_read", *columns]
    read = whole.index("text") if len(whole) == len(columns) else 0
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else tuple(model))

    def run(batches):
        languages, table, bias, temperature, threshold, shares, limits = shared.value or ([], None, None, 1.0, 1.0, None, None)
        if languages:
            table, bias = np.concatenate([table, shares], axis=1), np.concatenate([bias, np.zeros(len(languages), np.float32)])
        for batch in batches:
            data, offs = K.flat(batch.column(read))
            n = len(offs) - 1
            name, score, far = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            if languages:
                for a, b, d, o in K.pieces(data, offs):
                    z = logits(table, bias, d, o)
                    p = softmax(z[:, : len(languages)] / temperature)
                    at = p.argmax(1)
                    far[a:b] = z[np.arange(b - a), len(languages) + at] < limits[at]
                    own = np.flatnonzero(has_letter(d, o))
                    name[a + own] = np.array(languages, object)[at[own]]
                    score[a + own] = p[own, at[own]]
            rejected = (name == "und") | (score < threshold) | far
            yield pa.RecordBatch.from_arrays([*batch.columns[len(whole) - len(columns) :], pa.array(name, pa.string()), pa.array(score), pa.array(rejected)], names=[*columns, "lang_pred", "lang_score", "lang_rejected"])

    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(f"lang_{c}", t) for c, t in (("pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())))])
    given = [F.col(f"`{c}`") for c in columns]
    return docs.select(*([] if len(whole) == len(columns) else [F.col("text").cast("string").alias("_read")]), *given).mapInArrow(K.tidy(run), schema)


def identify(docs: DataFrame, remainder: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang_pred, lang_score, lang_rejected, held_out; learns from rows that are not held out."""
    slim = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(slim.filter(~C.held_out("doc_id", remainder)), sample)
    out = predict(slim, model, ["doc_id"])
    return out.withColumn("held_out", C.held_out("doc_id", remainder))


K.ship(__name__)
