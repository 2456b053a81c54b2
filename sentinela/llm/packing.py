"""Packing (operator 9): best-fit decreasing into fixed windows.

``token_pieces`` encodes every whole text and cuts it into full windows and a rest; ``best_fit_plan`` packs the
histogram of piece lengths; ``pack`` deals the pieces out to the windows. Only the histogram (at most ``window``
rows whatever the input) reaches the driver: windows with the same room left are interchangeable, so best fit is
run over counts, with a segment tree indexed by remaining capacity, and yields a few runs of windows per length.

Defined results: a null or empty text has the end id alone; repeated rows are packed once each; a null doc_id is
kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import common as C
from sentinela.llm import kernels as K
from sentinela.llm import tokens as T

WINDOW = 4096
#: Above this many runs the plan is joined by shuffle instead of being broadcast (a run is 6 numbers).
BROADCAST_RUNS = 20_000
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 2_000_000


def token_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece: full windows first, then the rest."""

    def run(batches):
        for batch in batches:
            data, offs = K.flat(batch.column(1))
            for a, b, d, o in K.pieces(data, offs, ENCODE_BYTES):
                ids, begins = T.encode(d, o, vocabulary, end_id)
                raw = memoryview(ids.astype("<u4")).cast("B")
                n = np.diff(begins)
                parts = -(-n // window)
                doc = np.repeat(np.arange(b - a), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, n[doc] - start)
                at = (begins[doc] + start) * 4
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(K.tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class RoomTree:
    """A segment tree over remaining capacities 1..size that counts the open windows of each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open window has."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, rank_from, rank_to, first_window, per_window, offset).

    The pieces of ``length`` with ranks in [rank_from, rank_to) go to windows from ``first_window`` on,
    ``per_window`` to each, the first of them at ``offset``. Placing equal pieces one by one with best fit fills
    one window until no further piece fits, which is what taking ``room // length`` at a time does.
    """
    tree, open_runs, runs, windows = RoomTree(window), defaultdict(deque), [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_runs[room].append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = window
                n = -(-left // (window // length))
                put(room, windows, n)
                windows += n
            per = room // length
            first, n = open_runs[room].popleft()
            take = min(n, left // per) or 1
            got = min(left, take * per)
            each = got // take
            if n > take:
                open_runs[room].appendleft((first + take, n - take))
            tree.add(room, -take)
            runs.append((length, rank, rank + got, first, each, window - room))
            put(room - each * length, first, take)
            rank, left = rank + got, left - got
    return runs


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to a table of pieces that was written (not computed anew on each read)."""
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_plan(histogram, window)
    plan = spark.createDataFrame(runs, "run_length long, rank_from long, rank_to long, first_window long, per_window long, run_offset long")
    buckets = C.bucket_count(sum(histogram.values()), 20_000)
    ranked = C.running_total(pieces, ["length"], ["doc_id", "start", "ids_crc32"], F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)), F.lit(1), "_rank")
    if len(runs) <= BROADCAST_RUNS:
        plan = F.broadcast(plan)
    on = (F.col("length") == F.col("run_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    along = F.col("_rank") - F.col("rank_from")
    return ranked.join(plan, on).select(
        *pieces.columns,
        (F.col("first_window") + F.floor(along / F.col("per_window"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + F.pmod(along, F.col("per_window")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """Encode, cut and pack whole documents; see the module's docstring."""
    return pack(C.materialise(token_pieces(docs, vocabulary, window, end_id), "pieces"), window)


K.ship(__name__)
