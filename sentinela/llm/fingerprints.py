"""Document fingerprints (operator 4): a homomorphic multiset hash of paragraphs.

A paragraph is a line, or a sentence of one (it ends after ``.``, ``!`` or ``?`` and a following blank), with its
delimiter. Two 64-bit hashes of it are stretched to ``WIDTH`` signs, and a document's fingerprint is the sum of
these vectors modulo 2**16: independent of order, and paragraphs can be added or taken away without the text.
Signs are independent between different paragraphs, so the product of two fingerprints estimates how many
paragraphs they share (standard error about the root of both sizes over ``WIDTH``): ``likeness`` is the estimated
shared share of their union, 1 for equal fingerprints.

Defined results: a null or empty text has no paragraph and the zero fingerprint; equal texts have equal ones.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import common as C
from sentinela.llm import kernels as K

WIDTH = 256
#: Documents per range of ids in ``with_next``.
RANGE_DOCS = 8_000


def unit_cuts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the paragraphs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    cut[1:] |= data == 10
    stop = (data == 46) | (data == 33) | (data == 63)
    cut[2:-1] |= stop[:-2] & (data[1:-1] == 32)
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of int16 per document."""
    n = len(offs) - 1
    out = np.zeros((n, WIDTH), np.int16)
    starts, ends = unit_cuts(data, offs)
    if not len(starts):
        return out
    a = K.span_hash(K.prefix_hash(data), starts, ends)
    b = K.span_hash(K.prefix_hash(data, K.BYTE_VALUE_2), starts, ends)
    lanes = np.arange(1, WIDTH // 64 + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = K.mix(a[:, None] + K.mix(b[:, None] + lanes[None, :] * np.uint64(0x9E3779B97F4A7C15)))
    doc = K.doc_of(offs, starts)
    full, first = np.unique(doc, return_index=True)
    signs = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)
    ones = np.add.reduceat(signs, first, axis=0, dtype=np.int32)
    units = np.diff(np.append(first, len(doc)))
    out[full] = (2 * ones - units[:, None]).astype(np.int16)  # the sum of +1 and -1, modulo 2**16
    return out


def combine(left: np.ndarray, right: np.ndarray, sign: int = 1) -> np.ndarray:
    """Insert (1) or delete (-1) the paragraphs of one fingerprint in another."""
    return (left.astype(np.int32) + sign * right.astype(np.int32)).astype(np.uint16).view(np.int16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common paragraphs, row by row, from 0 to 1."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    both, own = (x * y).sum(1), (x * x).sum(1) + (y * y).sum(1)
    union = own - both
    out = np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)
    return np.where((a == b).all(1), 1.0, np.clip(out, 0.0, 1.0))


def text_of(prints: np.ndarray) -> pa.Array:
    return pa.array([base64.b64encode(r.tobytes()).decode() for r in prints.astype("<i2")], pa.string())


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, _range, _extra sorted inside each partition by descending doc_id, every range of ids closed by
    the row that follows it (_extra): a document's successor is the next row. One shuffle of the texts; the last
    document is followed by the first. Equal ids are ordered by text, null ids come last."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("_k", F.coalesce("doc_id", F.lit(-(2**63))))
    rows = base.count()
    n = C.bucket_count(rows, RANGE_DOCS)
    edges = [] if n == 1 else base.select(F.col("_k").cast("double").alias("_k")).approxQuantile("_k", [i / n for i in range(1, n)], 1 / (4 * n))
    shared = spark.sparkContext.broadcast(-np.array(sorted(set(edges), reverse=True), np.float64))

    @F.pandas_udf("int")
    def range_of(k):
        return k.__class__(np.searchsorted(shared.value, -k.to_numpy(np.float64), side="right").astype(np.int32), index=k.index)

    base = base.withColumn("_range", range_of("_k"))
    heads = sorted((r["_range"], r["_k"]) for r in base.groupBy("_range").agg(F.max("_k").alias("_k")).collect())
    closing = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]  # the head of a range closes the one before
    extra = spark.createDataFrame(closing, "_k long, _range int")
    firsts = base.drop("_range").join(F.broadcast(extra), "_k").groupBy("_k", "_range").agg(F.max(F.struct("text", "doc_id")).alias("r"))
    firsts = firsts.select(F.col("r.doc_id").alias("doc_id"), F.col("r.text").alias("text"), "_k", "_range", F.lit(True).alias("_extra"))
    every = base.withColumn("_extra", F.lit(False)).unionByName(firsts)
    order = ["_range", F.col("_extra").asc(), F.col("_k").desc(), F.col("text").desc()]
    return every.repartition(max(n, C.shuffle_parts(spark)), "_range").sortWithinPartitions(*order).select("doc_id", "text", "_range", "_extra")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is the text with its last floor(n_chars/2) code points replaced by as many first ones of the
    next document in descending order of doc_id.
    """

    def work(table: pa.Table):
        """Rows of a table but the last, each with the row after it."""
        n = table.num_rows - 1
        data, offs = K.flat(table.column("text"))
        points = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.searchsorted(points, offs)
        chars = np.diff(at)
        half = chars[:-1] // 2
        points = np.append(points, len(data))
        keep_to = points[at[1:-1] - half]
        take_to = points[at[1:-1] + np.minimum(half, chars[1:])]
        raw = data.tobytes()
        edited = [raw[a:b] + raw[b2:c] for a, b, b2, c in zip(offs[:-2].tolist(), keep_to.tolist(), offs[1:-1].tolist(), take_to.tolist(), strict=True)]
        prints = fingerprints(data, offs)
        e_data, e_offs = K.flat(pa.array(edited, pa.binary()))
        e_prints = fingerprints(e_data, e_offs)
        own = pa.array(~table.column("_extra").to_numpy()[:-1].astype(bool))
        cols = [table.column("doc_id").slice(0, n).combine_chunks(), pa.array(chars[:-1].astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in edited]), text_of(prints[:-1]), text_of(e_prints), pa.array(likeness(prints[:-1], e_prints)), pa.array(likeness(prints[:-1], prints[1:]))]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([c.filter(own) for c in cols], names=names)

    def run(batches):
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table])
            data_offs = K.flat(table.column("text"))[1]
            at = 0
            while at < table.num_rows - 1:  # a few million bytes at a time, one row shared with the next part
                end = max(at + 1, min(table.num_rows - 1, int(np.searchsorted(data_offs, data_offs[at] + 2_000_000))))
                yield work(table.slice(at, end - at + 1))
                at = end
            carry = table.slice(table.num_rows - 1)

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, out)


K.ship(__name__)
