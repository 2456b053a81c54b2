"""Records of large JSON arrays, one file read by many tasks.

A file is ``[record, ...]`` or an object whose ``data`` is such a list, on one line or many. Spark's text source cuts it
at every ``}``, split by split, and what a split must know of the text before it is found by a prefix scan:

1. Each split says whether it holds an odd number of quotes (a backslash takes the next character's meaning away), and, for
   a start inside and outside a string, how far its brackets move the depth and which keys open lists, by relative depth.
2. Running sums over a file's splits, a row each, give the state that each split starts in.
3. Each split then emits its whole records; one that crosses a border comes out in pieces, which are put together by the
   split that it starts in.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinela import durable

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_BRACKET = re.compile(r"[\[\]{}]")
_COLON = re.compile(r"\s*:\s*$")
#: What a row of ``pieces`` holds: a whole record, the end of one from before, the beginning of one, or a split inside one.
WHOLE, END, BEGIN, INSIDE = range(4)
_KEYS = "map<int,string>"


def tokens(segment: str) -> tuple[list[tuple[int, str, int, str]], int]:
    """Brackets of a segment (and the ``}`` that ended it): parity of quotes before it, bracket, place, key of a list; and the
    parity of all its quotes."""
    text = _ESCAPED.sub("  ", segment) if "\\" in segment else segment
    out, seen, quotes, last = [], 0, 0, -1
    for m in _BRACKET.finditer(text):
        place = m.start()
        quotes += text.count('"', seen, place)
        last = max(last, text.rfind('"', seen, place))
        named = m.group() == "[" and last >= 0 and _COLON.match(text, last + 1, place)
        out.append((quotes & 1, m.group(), place, text[text.rfind('"', 0, last) + 1 : last] if named else ""))
        seen = place
    quotes = (quotes + text.count('"', seen)) & 1
    return [*out, (quotes, "}", len(segment), "")], quotes


def segments(spark: SparkSession, path) -> DataFrame:
    """value, file, start: the text between closing braces in the order of the file, and where its split begins."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches):
    """(file, start) and the segment of each row."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)


def summaries(rows: DataFrame) -> DataFrame:
    """file, start, lead (the first character that is no blank), odd, and for both states depth0/1 and keys0/1."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("lead", pa.string()), ("odd", pa.int32()), *((f"depth{h}", pa.int64()) for h in (0, 1)), *((f"keys{h}", pa.map_(pa.int32(), pa.string())) for h in (0, 1))])

    def run(batches):
        at, lead, odd, depth, keys = None, "", 0, [0, 0], [{}, {}]

        def out():
            return pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "lead": lead, "odd": odd, **{f"depth{h}": depth[h] for h in (0, 1)}, **{f"keys{h}": list(keys[h].items()) for h in (0, 1)}}], schema)

        for value, file, start in _by_split(batches):
            if at != (file, start):
                if at is not None:
                    yield out()
                at, lead, odd, depth, keys = (file, start), "", 0, [0, 0], [{}, {}]
            lead = lead or value.lstrip("\ufeff \t\r\n")[:1]
            found, parity = tokens(value)
            for p, bracket, _, key in found:
                h = (p + odd) & 1  # outside a string if the split starts in this state
                if bracket in "[{":
                    keys[h][depth[h]] = key if bracket == "[" else ""
                    depth[h] += 1
                else:
                    depth[h] -= 1
            odd ^= parity
        if at is not None:
            yield out()

    return rows.mapInArrow(run, f"file string, start long, lead string, odd int, depth0 long, depth1 long, keys0 {_KEYS}, keys1 {_KEYS}")


def states(split: DataFrame) -> DataFrame:
    """file, start, inside (a string), depth, base (of a record's opening brace) and key of the open list, at each start."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = split.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    pick = lambda c: F.when(F.col("inside") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    out = out.withColumn("depth", F.coalesce(F.sum(pick("depth")).over(before), F.lit(0)))
    out = out.withColumn("_key", F.try_element_at(pick("keys"), (1 - F.col("depth")).cast("int")))
    base = F.when(F.first("lead").over(order) == "[", 1).otherwise(2)
    return out.select("file", "start", F.col("inside").cast("int"), "depth", base.alias("base"), F.coalesce(F.last("_key", True).over(before), F.lit("")).alias("key"))


def pieces(rows: DataFrame, entry: DataFrame, field: str) -> DataFrame:
    """file, start, seq, kind, text: whole records and pieces of those that cross a border."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])

    def run(batches):
        at, held = None, []
        inside = depth = base = seq = 0
        key, record, began = "", None, False

        def close():
            if record is not None:
                held.append((*at, seq, BEGIN if began else INSIDE, "".join(record)))

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held.clear()
            return batch

        for batch in batches:
            for value, file, start, *state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (file, start):
                    close()
                    at, seq, (inside, depth, base, key) = (file, start), 0, state
                    record, began = ([] if depth > base and (base == 1 or key == field) else None), False
                found, parity = tokens(value)
                taken = 0  # where the record's part of this segment begins
                for p, bracket, place, name in found:
                    if (p + inside) & 1:
                        continue
                    if bracket in "[{":
                        if base == 2 and depth == 1:
                            key = name if bracket == "[" else ""
                        if bracket == "{" and depth == base and record is None and (base == 1 or key == field):
                            record, began, taken = [], True, place
                        depth += 1
                    else:
                        depth -= 1
                        if depth == base and bracket == "}" and record is not None:
                            record.append(value[taken:] + "}")
                            held.append((*at, seq, WHOLE if began else END, "".join(record)))
                            seq, record = seq + 1, None
                inside ^= parity
                if record is not None:
                    record.append(value[taken:] + "}")
                if len(held) >= 2_000:
                    yield out()
        close()
        if held:
            yield out()

    told = rows.join(F.broadcast(entry), ["file", "start"]).select("value", "file", "start", "inside", "depth", "base", "key")
    return told.mapInArrow(run, "file string, start long, seq long, kind int, text string")


def records(spark: SparkSession, path, field: str = "data") -> DataFrame:
    """text, _ord: each record's JSON, and a number in the order of its file. ``path``: a file, a glob or a list of them.

    The state of each split (a row for ``spark.sql.files.maxPartitionBytes`` of text) is broadcast.
    """
    rows = segments(spark, path)
    found = durable.materialise(pieces(rows, durable.materialise(states(summaries(rows)), "json-states"), field), "json-records")
    order = Window.partitionBy("file").orderBy("start", "kind")
    torn = found.filter(F.col("kind") != WHOLE).withColumn("_of", F.last(F.when(F.col("kind") == BEGIN, F.col("start")), True).over(order))
    torn = torn.groupBy("file", "_of").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "text", "seq"))).alias("p"))  # the pieces of one record
    torn = torn.filter(F.exists("p", lambda x: x["kind"] == END)).select("file", F.col("_of").alias("start"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.element_at("p", 1)["seq"].alias("seq"))
    every = found.filter(F.col("kind") == WHOLE).select("file", "start", "text", "seq").unionByName(torn)
    place = F.shiftleft(F.pmod(F.xxhash64("file"), F.lit(1 << 19)), 43) + F.col("start") + F.col("seq")
    return every.select("text", place.alias("_ord"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
