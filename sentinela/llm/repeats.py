"""Exact repeated windows (operator 5): a depth-limited radix sort of suffixes.

Every byte that lies in a window of ``depth`` bytes that starts at two or more places is removed. Suffixes are
ordered by their first ``depth`` bytes only, most significant digit first; the groups that are left at that depth
are exactly the repeated windows.

* First digit: the ``gram``-byte string that is the least (by hash, leftmost first) inside the window. Equal
  windows have the same one at the same place, so it splits suffixes as a leading digit does, and all windows
  that share one occurrence of it form one stretch of text (a run): one row per run, not one per suffix.
  Runs whose digit occurs once cannot repeat and are done.
* Second digit: the run's own bytes, by hash. Where two runs have the same bytes, all their windows repeat.
* Remaining digits: one copy of each other run sends its bytes to a bucket of its first digit, where
  most-significant-digit passes order the windows, eight bytes a pass; groups of one drop out at every pass.
  A first digit with very many different runs (a common line amid other text) would meet in one task; its windows
  take two 64-bit hashes of all their bytes as one last digit and are grouped in the cluster with map-side sums.

Defined results: a null or empty text has no windows; texts shorter than ``depth`` keep all bytes; repeated rows
count as further places; an empty table gives no rows. Matches never cross documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import common as C
from sentinela.llm import kernels as K

DEPTH = 200
GRAM = 48
#: A first digit with more different runs than this is resolved by its windows' hashes, grouped in the cluster.
HOT_RUNS = 20_000
#: Runs per bucket of the last passes.
BUCKET_RUNS = 3_000
#: Windows that a task of these passes sorts at once.
WINDOWS = 500_000
RUN = "key binary, first int, last int, at int, digit long, body long"
PART = "key binary, single boolean, hot boolean, digit long, at int, low int, high int, body binary, window_a long, window_b long"


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values (block prefix and suffix minima)."""
    n = len(h) - width + 1
    pad = -len(h) % width
    full = np.concatenate([h, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def stretch_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """The unmixed hash of the ``width`` bytes at every position."""
    with np.errstate(over="ignore"):
        return (prefix[width:] - prefix[:-width]) * K.powers(K.BASE_INV, len(prefix))[: len(prefix) - width]


def runs_of(data: np.ndarray, offs: np.ndarray, depth: int, gram: int, bodies: bool = True):
    """Runs of windows with one first digit: document, first and last window, digit's place, digit, body hash."""
    n = len(data)
    empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if n < depth:
        return empty
    digit = stretch_hash(K.prefix_hash(data), gram)
    bits = np.uint64(31)  # fixed, so that every piece orders digits alike; a document is shorter than 2 GiB
    least = sliding_least((digit >> bits << bits) | np.arange(len(digit), dtype=np.uint64), depth - gram + 1)
    inside = np.ones(len(least), bool)
    for x in offs[1:].tolist():
        inside[max(0, x - depth + 1) : x] = False
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[1:] |= ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return empty
    at = (least[first] & np.uint64((1 << 31) - 1)).astype(np.int64)
    stops = np.append(np.flatnonzero(~inside | new), len(least))
    last = stops[np.searchsorted(stops, first, side="right")] - 1
    d = K.doc_of(offs, first)
    body = K.span_hash(K.prefix_hash(data, K.BYTE_VALUE_2), first, last + depth) if bodies else None
    return d, first - offs[d], last - offs[d], at - offs[d], digit[at], body


def text_runs(keyed: DataFrame, depth: int, gram: int) -> DataFrame:
    """The runs of a table (key, text)."""

    def run(batches):
        for batch in batches:
            data, offs = K.flat(batch.column(1))
            for start, _, d, o in K.pieces(data, offs):
                doc, first, last, at, digit, body = runs_of(d, o, depth, gram)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + start)), *(pa.array(x.astype(np.int32)) for x in (first, last, at)), *(pa.array(x.view(np.int64)) for x in (digit, body))],
                    names=["key", "first", "last", "at", "digit", "body"],
                )

    return keyed.select("key", "text").mapInArrow(K.tidy(run), RUN)


def digit_counts(keyed: DataFrame, depth: int, gram: int) -> DataFrame:
    """digit, n: how many runs have each first digit, summed within a batch before the shuffle."""

    def run(batches):
        for batch in batches:
            data, offs = K.flat(batch.column(0))
            for _, _, d, o in K.pieces(data, offs):
                digit, n = np.unique(runs_of(d, o, depth, gram, bodies=False)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(digit.view(np.int64)), pa.array(n.astype(np.int64))], names=["digit", "n"])

    return keyed.select("text").mapInArrow(K.tidy(run), "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n"))


def radix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Most-significant-digit passes over the windows at ``starts``: which share all ``depth`` bytes with another
    window of their group. A digit is the next eight bytes as a number; each pass sorts every group by it, where its
    members differ, and only groups of two or more reach the next one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    digits = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        digits = digits << np.uint64(8) | padded[k : k + len(digits)]
    live = np.argsort(group, kind="stable")
    name = group[live]
    for at in [*range(0, depth - 8, 8), max(0, depth - 8)]:
        d = digits[starts[live] + at]
        border = name[1:] != name[:-1]
        mixed = (d[1:] != d[:-1]) & ~border
        if mixed.any():
            own = np.concatenate([[0], np.cumsum(border)])
            unequal = np.zeros(own[-1] + 1, bool)
            unequal[own[1:][mixed]] = True
            where = np.flatnonzero(unequal[own])
            by = where[np.lexsort((d[where], own[where]))]
            live[where], d[where] = live[by], d[by]
            border |= d[1:] != d[:-1]
        twin = np.zeros(len(live), bool)
        twin[1:] = ~border
        twin[:-1] |= ~border
        name = np.concatenate([[0], np.cumsum(border)])[: len(live)][twin]
        live = live[twin]
    repeated = np.zeros(len(starts), bool)
    repeated[live] = True
    return repeated


def ranges(row: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (row, window) pairs as stretches of consecutive windows: row, first, last."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], window[at], window[np.append(at[1:], len(row)) - 1] if len(at) else window


def portions(digit: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Runs (by number) and the first and last place of the digit in their windows, about ``WINDOWS`` windows at a time.
    Windows that can be equal, of one digit at one place, come together; each portion has all of them. ``least`` and
    ``most``: of each run the places of its digit in its windows."""
    by = np.argsort(digit, kind="stable")
    upto = np.cumsum((most - least + 1)[by])
    edge = np.append(np.flatnonzero(np.diff(digit[by])) + 1, len(by)) if len(by) else np.zeros(0, np.int64)
    x = 0
    while x < len(by):
        done = upto[x - 1] if x else 0
        fit = edge[(edge > x) & (upto[edge - 1] <= done + WINDOWS)]
        y = int(fit[-1] if len(fit) else edge[edge > x][0])
        rows = by[x:y]
        low, high = int(least[rows].min()), int(most[rows].max())
        step = high - low + 1 if len(fit) else max(1, WINDOWS // len(rows))  # a run has a window for each place at most
        for place in range(low, high + 1, step):
            yield rows, place, min(high, place + step - 1)
        x = y


def repeated_in_bucket(table: pa.Table, depth: int) -> pa.Table:
    """Stretches of repeated windows in the single runs of a bucket.

    ``body`` holds the bytes from window ``low`` to window ``high``; a window's group is the digit and its place in
    the window, so windows that differ in either never meet, and are sorted some at a time.
    """
    low, high, at, digit = (table.column(c).to_numpy() for c in ("low", "high", "at", "digit"))
    single, body, keys = table.column("single").to_numpy(), table.column("body").combine_chunks(), table.column("key")
    found = [(np.zeros(0, np.int64),) * 2]
    for rows, least, most in portions(digit, at - high, at - low):
        data, offs = K.flat(body.take(pa.array(rows)))
        begin, end = np.maximum(low[rows], at[rows] - most), np.minimum(high[rows], at[rows] - least)
        n = np.maximum(0, end - begin + 1).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        window = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        group = np.unique(digit[rows], return_inverse=True)[1].ravel()[row] * (depth + 1) + (at[rows][row] - window)
        hit = radix_groups(data, offs[row] + window - low[rows][row], group, depth) & single[rows][row]
        found.append((rows[row[hit]], window[hit].astype(np.int64)))
    row, window = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((window, row))
    r, first, last = ranges(row[by], window[by])
    return pa.table([keys.take(pa.array(r)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["key", "first", "last"])


def part(key: pa.Array, single, hot: bool, digit, at, low, high, bodies=None, wa=None, wb=None) -> pa.RecordBatch:
    n = len(key)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [key, pa.array(single), pa.array(np.full(n, hot)), pa.array(digit), *(pa.array(x.astype(np.int32)) for x in (at, low, high)), pa.nulls(n, pa.binary()) if bodies is None else pa.array(bodies, pa.binary()), none if wa is None else pa.array(wa.view(np.int64)), none if wb is None else pa.array(wb.view(np.int64))],
        names=["key", "single", "hot", "digit", "at", "low", "high", "body", "window_a", "window_b"],
    )


def bodies_of(batch: pa.RecordBatch, depth: int):
    """The rows of ``PART`` for a batch (key, text, runs), some documents at a time: a worker keeps the powers of the
    longest stretch that it has hashed."""
    text, every = K.flat(batch.column(1)), batch.column(2)
    for x, y, data, offs in K.pieces(*text):
        lists, keys = every.slice(x, y - x), batch.column(0).slice(x, y - x)
        fields = lists.flatten()
        doc = np.repeat(np.arange(y - x), np.diff(lists.offsets.to_numpy()))
        first, last, at, digit, single, hot = (np.asarray(fields.field(k)) for k in ("first", "last", "at", "digit", "single", "hot"))
        single, hot = single.astype(bool), hot.astype(bool)
        cold = np.flatnonzero(~hot)
        raw = data.tobytes()
        begin, end = offs[doc] + first, offs[doc] + last + depth
        bodies = [raw[i:j] for i, j in zip(begin[cold].tolist(), end[cold].tolist(), strict=True)]
        yield part(keys.take(pa.array(doc[cold])), single[cold], False, digit[cold], at[cold], first[cold], last[cold], bodies)
        if hot.any():
            a, b = K.prefix_hash(data), K.prefix_hash(data, K.BYTE_VALUE_2)
            for some in np.array_split(np.flatnonzero(hot), max(1, int(hot.sum()) // 2000)):
                n = (last - first + 1)[some].astype(np.int64)
                row = np.repeat(some, n)
                w = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                s = offs[doc[row]] + w
                yield part(keys.take(pa.array(doc[row])), single[row], True, digit[row], at[row] - w, w, w, None, K.span_hash(a, s, s + depth), K.span_hash(b, s, s + depth))


def fetch_bodies(keyed: DataFrame, rest: DataFrame, depth: int) -> DataFrame:
    """The bytes of the runs listed per key; of hot digits, a row with two hashes for each window instead."""

    def run(batches):
        for batch in batches:
            yield from bodies_of(batch, depth)

    listed = rest.groupBy("key").agg(F.collect_list(F.struct("first", "last", "at", "digit", "single", "hot")).alias("runs"))
    return keyed.select("key", "text").join(listed, "key").select("key", "text", "runs").mapInArrow(K.tidy(run), PART)


def repeated_windows(keyed: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """key, first, last: stretches of windows whose bytes start at two or more places of the table (key, text)."""
    many = C.materialise(digit_counts(keyed, depth, gram).filter("n > 1").select("digit"), "digits")
    runs = C.materialise(text_runs(keyed, depth, gram).join(many, "digit", "left_semi"), "runs")
    bodies = runs.groupBy("digit", "body").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last", "at")).alias("one"))
    bodies = C.materialise(bodies, "bodies")
    whole = runs.join(bodies.filter("n > 1").select("digit", "body"), ["digit", "body"], "left_semi").select("key", "first", "last")
    kinds = bodies.groupBy("digit").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    rest = bodies.join(kinds, "digit").select("digit", "one.*", (F.col("n") == 1).alias("single"), (F.col("kinds") > HOT_RUNS).alias("hot"))
    parts = C.materialise(fetch_bodies(keyed, rest, depth), "parts")
    cold, hot = parts.filter("not hot"), parts.filter("hot")
    buckets = C.bucket_count(cold.count(), BUCKET_RUNS)
    dealt = cold.select("key", "single", "digit", "at", "low", "high", "body", F.pmod(F.xxhash64("digit"), F.lit(buckets)).alias("bucket"))
    from_cold = dealt.groupBy("bucket").applyInArrow(lambda t: repeated_in_bucket(t, depth), "key binary, first int, last int")
    name = ["digit", "at", "window_a", "window_b"]
    twice = hot.groupBy(*name).agg(F.count("*").alias("_n")).filter("_n > 1")
    from_hot = hot.filter("single").join(twice.drop("_n"), name, "left_semi").select("key", F.col("low").alias("first"), F.col("high").alias("last"))
    return whole.unionByName(from_cold).unionByName(from_hot)


def cut_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, stop of each maximal removed run), kept (the remaining bytes)."""
    keyed = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ident = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("\x00"), F.col("text")).cast("binary")))
    keyed = keyed.withColumn("key", ident)
    spans = repeated_windows(keyed, depth, gram).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("windows"))

    def run(batches):
        for batch in batches:
            every = batch.column(2).fill_null([]) if batch.column(2).null_count else batch.column(2)
            for x, y, data, offs in K.pieces(*K.flat(batch.column(1))):
                n, size, lists = y - x, np.diff(offs), every.slice(x, y - x)
                doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                fields = lists.flatten()
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, offs[doc] + np.asarray(fields.field("first")), 1)
                np.add.at(change, offs[doc] + np.asarray(fields.field("last")) + depth, -1)
                gone = np.cumsum(change)[:-1] > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                inner = offs[:-1][offs[:-1] < len(data)]
                edge[inner] = gone[inner]
                start = np.flatnonzero(edge)
                halt = ~gone
                halt[inner] = True
                stop_at = np.append(np.flatnonzero(halt), len(data))
                stop = stop_at[np.searchsorted(stop_at, start, side="right")]
                home = K.doc_of(offs, start)
                per = np.bincount(home, minlength=n)
                removed = np.bincount(home, stop - start, n).astype(np.int64)
                left = ~gone
                kept_offs = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(kept_offs.tobytes()), pa.py_buffer(data[left].tobytes())])
                pairs = pa.StructArray.from_arrays([pa.array((start - offs[home]).astype(np.int32)), pa.array((stop - offs[home]).astype(np.int32))], names=["start", "stop"])
                where = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, n), pa.array(size), pa.array(removed), where, kept], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = keyed.join(spans, "key", "left").select("doc_id", "text", "windows")
    return out.mapInArrow(K.tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>, kept binary")


K.ship(__name__)
