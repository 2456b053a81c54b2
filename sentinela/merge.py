"""Merges into a stored table by key that rewrite only the buckets which new rows touch. A version is a list of folders,
one a bucket; the folders of untouched buckets are those of the version before, and readers keep theirs until the
pointer moves."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela import publish
from sentinela.operators import core

#: Buckets of a new table; their number stays. It bounds what a merge lists on the driver.
BUCKETS = 256


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, out: str) -> DataFrame | None:
    """bucket, folder (null: no rows), schema, of the current version."""
    fs, pointer = publish._fs(spark, f"{out}/{publish.POINTER}")
    return spark.read.parquet(publish.current(spark, out)) if fs.exists(pointer) else None


def merge(new: DataFrame, out: str, keys: list[str], order: list[str], newest: bool = False, buckets: int = BUCKETS, files: int = 1) -> list[int]:
    """Merge rows into the table at ``out`` and return the buckets that were written anew. Of rows with one key the
    stored one stays (``newest``: the new one), and of several new ones the first by ``order``; null keys are equal to each
    other. Columns go by name, missing ones are null; a column's type never changes. ``files``: of a bucket.

    On an error the version before stays current. One merge at a time.
    """
    spark = new.sparkSession
    known = _folders(spark, out)
    entries = known.collect() if known is not None else []  # a row per bucket
    buckets = len(entries) or buckets
    schema = T.StructType.fromJson(json.loads(entries[0]["schema"])) if entries else new.schema
    types = {f.name: f.dataType for f in schema.fields}
    changed = [f.name for f in new.schema.fields if types.get(f.name, f.dataType) != f.dataType]
    if changed:
        raise ValueError(f"columns of another type: {', '.join(changed)}")
    schema = T.StructType([*schema.fields, *[f for f in new.schema.fields if f.name not in types]])
    placed = new.withColumn("_bucket", _bucket(keys, buckets))
    touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())  # at most ``buckets``
    folder = {e["bucket"]: e["folder"] for e in entries}
    if touched or not entries:
        run = f"{out}/data/{uuid.uuid4().hex}"
        old = [folder[b] for b in touched if folder.get(b)]
        stored = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
        frames = [new, stored] if newest else [stored, new]
        merged = core.merge_first(frames, keys, order).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])
        merged = merged.withColumn("_bucket", _bucket(keys, buckets)).repartition(max(1, len(touched) * files), "_bucket", F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(files)))
        fs, root = publish._fs(spark, run)
        version = f"v-{uuid.uuid4().hex}"
        try:
            merged.write.option("compression", "zstd").partitionBy("_bucket").parquet(run)
            folder.update({b: f"{run}/_bucket={b}" for b in touched})
            rows = [(b, folder.get(b), schema.json()) for b in range(buckets)]
            spark.createDataFrame(rows, "bucket int, folder string, schema string").coalesce(1).write.parquet(f"{out}/{version}")
            publish._point(spark, out, version)
        except Exception:
            fs.delete(root, True)
            raise
    return touched


def read(spark: SparkSession, out: str) -> DataFrame:
    """The current version."""
    entries = _folders(spark, out).collect()
    schema = T.StructType.fromJson(json.loads(entries[0]["schema"]))
    folders = [e["folder"] for e in entries if e["folder"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def retire(spark: SparkSession, out: str) -> None:
    """Remove the versions before the current one, and the bucket folders that only they name."""
    used = {e["folder"] for e in _folders(spark, out).collect()}
    publish.retire(spark, out, 1)
    fs, data = publish._fs(spark, f"{out}/data")
    for run in fs.listStatus(data):
        for f in fs.listStatus(run.getPath()):
            path = f"{out}/data/{run.getPath().getName()}/{f.getPath().getName()}"
            if f.isDirectory() and path not in used:
                fs.delete(f.getPath(), True)
