"""Staging files, the completeness gate and all-or-nothing publication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela import layout as files

REQUIRED = ["empresas", "qsa", "contratos", "sancoes", "servidores", "doacoes"]
OPTIONAL = ["rais"]
#: A small file with the name of the current version's folder.
POINTER = "CURRENT"


class Incomplete(Exception):
    """A required source is missing or empty; ``missing`` names them."""

    def __init__(self, missing: list[str]):
        super().__init__(f"missing or empty: {', '.join(missing)}")
        self.missing = missing


def write_staging(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _fs(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def check_complete(tables: dict[str, DataFrame | None]) -> list[str]:
    """Raise ``Incomplete`` unless every required table has a row; return warnings about optional ones."""
    empty = lambda n: tables.get(n) is None or not tables[n].limit(1).count()
    missing = [n for n in REQUIRED if empty(n)]
    if missing:
        raise Incomplete(missing)
    return [f"{n} is missing" for n in OPTIONAL if empty(n)]


def _point(spark: SparkSession, out: str, version: str) -> None:
    """Put the pointer file in place by one rename that replaces the old one: readers see either version."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, tmp = _fs(spark, f"{out}/_POINTER-{version}")
    stream = fs.create(tmp, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    current_path = _fs(spark, f"{out}/{POINTER}")[1]
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(tmp, current_path, replace)
    except Exception:
        fs.delete(tmp, True)
        raise


def publish(spark: SparkSession, tables: dict[str, DataFrame], out: str, layout: dict | None = None, keep: int | None = None) -> str:
    """Write every table to a new version folder, then point ``out``/CURRENT at it by one overwriting rename. On an
    error the new folder goes and the old version stays current. ``layout``: how tables are laid out (``layout.LAYOUT``);
    ``keep``: how many versions stay, this one included (all, if not given)."""
    version = f"v-{uuid.uuid4().hex}"
    fs, root = _fs(spark, f"{out}/{version}")
    try:
        for name, df in tables.items():
            path = f"{out}/{version}/{name}"
            if layout and name in layout:
                files.write(df, path, layout[name])
            else:
                write_staging(df, path)
        _point(spark, out, version)
    except Exception:
        fs.delete(root, True)
        raise
    if keep is not None:
        retire(spark, out, keep)
    return version


def retire(spark: SparkSession, out: str, keep: int) -> None:
    """Remove all but the newest ``keep`` versions; never the current one."""
    fs, root = _fs(spark, out)
    now = current(spark, out).rpartition("/")[2]
    old = [f for f in fs.listStatus(root) if f.getPath().getName().startswith("v-") and f.getPath().getName() != now]
    for f in sorted(old, key=lambda f: f.getModificationTime(), reverse=True)[max(0, keep - 1) :]:
        fs.delete(f.getPath(), True)


def published(spark: SparkSession, out: str, layout: dict | None = None) -> dict[str, DataFrame]:
    """The tables of the current version."""
    base = current(spark, out)
    fs, root = _fs(spark, base)
    names = sorted(f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory())
    return {n: files.read(spark, f"{base}/{n}", (layout or {}).get(n)) for n in names}


def current(spark: SparkSession, out: str) -> str:
    """The folder of the current version."""
    return f"{out}/{spark.read.text(f'{out}/{POINTER}').first()[0]}"


def table_counts(spark: SparkSession, out: str, names: list[str]) -> DataFrame:
    base, every = current(spark, out), None
    for n in names:
        one = read_staging(spark, f"{base}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("tabela"), "n")
        every = one if every is None else every.unionByName(one)
    return every
