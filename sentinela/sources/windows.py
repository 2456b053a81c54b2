"""Contracts delivered by day, as a Python data source: one partition for each window of 31 days.

An archive holds a folder ``mes=YYYY-MM`` for each month with deliveries; each line of its files is a day in ISO form, a
tab, and one page, a JSON object ``{"data": [...]}`` or a bare list. A page is bounded by who delivers it, so a task holds
one page at a time. A window opens the months that it touches, two as a rule, and parses its own days only.

The first and last day asked for choose the windows, and so the months, before anything is opened. They are
options, not conditions pushed down: Spark 4.1 keeps what one plan pushes into a Python data source for every later plan
of the same DataFrame, so a filtered count would leave rows out of the next, unfiltered one.

``ingest`` writes each window that has ended as its own Parquet file, which appears whole or not at all. A run that
breaks off leaves the finished windows, and the next run reads only the others.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from sentinela import sources

DAYS = 31
PAGES = "janela date, dia date, pagina string"
_ONE_DAY = dt.timedelta(days=1)


def windows(start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """First and last day of each window from start to end, both included; the last one may be cut short."""
    out = []
    while start <= end:
        out.append((start, min(start + dt.timedelta(days=DAYS - 1), end)))
        start = out[-1][1] + _ONE_DAY
    return out


def closed(start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """The windows that are over by the end of ``end``."""
    return [w for w in windows(start, end) if (w[1] - w[0]).days == DAYS - 1]


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(fs: pafs.FileSystem, folder: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


@dataclass
class Window(ds.InputPartition):
    janela: dt.date
    first: dt.date
    last: dt.date


class PageReader(ds.DataSourceReader):
    def __init__(self, path: str, start: dt.date, end: dt.date, first: dt.date, last: dt.date, skip: frozenset[str]):
        self.path, self.start, self.end, self.first, self.last, self.skip = path, start, end, first, last, skip

    def partitions(self):
        """The windows of the whole range that still hold a day asked for; their borders do not move with it."""
        out = []
        for a, b in windows(self.start, self.end):
            first, last = max(a, self.first), min(b, self.last)
            if first <= last and a.isoformat() not in self.skip:
                out.append(Window(a, first, last))
        return out or [Window(self.start, self.start, self.start - _ONE_DAY)]

    def read(self, partition) -> Iterator[tuple]:
        fs, folder = open_folder(self.path)
        for month in _months(partition.first, partition.last):
            for name in _files(fs, f"{folder}/mes={month}"):
                with fs.open_input_stream(name) as stream:
                    for line in _lines(stream):
                        day, _, page = line.partition("\t")
                        day = dt.date.fromisoformat(day)
                        if partition.first <= day <= partition.last:
                            yield partition.janela, day, page


def _months(first: dt.date, last: dt.date) -> list[str]:
    return sorted({(first + dt.timedelta(days=i)).strftime("%Y-%m") for i in range((last - first).days + 1)})


def _lines(stream, step: int = 1 << 20) -> Iterator[str]:
    rest = b""
    while block := stream.read(step):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode("utf-8") for x in whole if x.strip())
    if rest.strip():
        yield rest.decode("utf-8")


class PageSource(ds.DataSource):
    """Options, days in ISO form and both included: path; start and end, which the windows are laid from; first and
    last, the days to read (by default all); skip, first days of windows to leave out, by commas."""

    @classmethod
    def name(cls):
        return "contract_pages"

    def schema(self):
        return PAGES

    def reader(self, schema):
        o = self.options
        skip = frozenset(x for x in o.get("skip", "").split(",") if x)
        start, end = dt.date.fromisoformat(o["start"]), dt.date.fromisoformat(o["end"])
        first, last = (dt.date.fromisoformat(o[k]) if o.get(k) else d for k, d in (("first", start), ("last", end)))
        return PageReader(o["path"], start, end, first, last, skip)


@dataclass
class Written(ds.WriterCommitMessage):
    files: tuple[str, ...]


class WindowWriter(ds.DataSourceArrowWriter):
    """A file for each ``janela``. All rows of one must lie in one task, as they do when read from the pages."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, folder = open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        parts: dict[dt.date, tuple[str, pq.ParquetWriter]] = {}
        try:
            for batch in iterator:
                at = batch.schema.get_field_index("janela")
                for janela in batch.column(at).unique().to_pylist():
                    rows = batch.filter(pc.equal(batch.column(at), pa.scalar(janela, pa.date32()))).drop_columns(["janela"])
                    if janela not in parts:
                        temp = f"{folder}/.{janela.isoformat()}-{uuid.uuid4().hex}"
                        parts[janela] = temp, pq.ParquetWriter(temp, rows.schema, filesystem=fs)
                    parts[janela][1].write_batch(rows)
            for _, out in parts.values():
                out.close()
            for janela, (temp, _) in parts.items():
                fs.move(temp, f"{folder}/{window_file(janela)}")
        except BaseException:
            for temp, out in parts.values():
                out.close()
                if fs.get_file_info(temp).is_file:
                    fs.delete_file(temp)
            raise
        return Written(tuple(window_file(j) for j in parts))

    def commit(self, messages):
        every = [f for m in messages if m is not None for f in m.files]
        twice = sorted({f for f in every if every.count(f) > 1})
        if twice:
            fs, folder = open_folder(self.path)
            for f in twice:
                fs.delete_file(f"{folder}/{f}")
            raise ValueError(f"rows of one window came from several tasks: {twice}")

    def abort(self, messages):
        """Finished windows stay: each is whole."""


class WindowSink(ds.DataSource):
    """Option: path, the folder that window files go to."""

    @classmethod
    def name(cls):
        return "contract_windows"

    def writer(self, schema, overwrite):
        return WindowWriter(self.options["path"])


def window_file(janela: dt.date) -> str:
    return f"window_{janela.isoformat()}.parquet"


def finished(path: str) -> set[str]:
    """First days of the windows in a folder of window files."""
    fs, folder = open_folder(path)
    return {f.rpartition("/")[2][len("window_") : -len(".parquet")] for f in _files(fs, folder) if f.rpartition("/")[2].startswith("window_")}


def pages(spark: SparkSession, path: str, start: dt.date, end: dt.date, first: dt.date | None = None, last: dt.date | None = None, skip: set[str] = frozenset()) -> DataFrame:
    """janela, dia, pagina of the days from first to last, of an archive whose windows are laid from start to end."""
    spark.dataSource.register(PageSource)
    asked = {"start": start, "end": end, "first": first or start, "last": last or end}
    return spark.read.format(PageSource.name()).options(path=path, skip=",".join(sorted(skip)), **{k: d.isoformat() for k, d in asked.items()}).load()


def contracts(found: DataFrame) -> DataFrame:
    """The contracts on pages, with the columns of the staging table, ``janela`` and ``dia``. A page that is no JSON
    gives an error rather than a window that looks finished."""
    wrapped = F.when(F.ltrim("pagina").startswith("["), F.concat(F.lit('{"data":'), F.col("pagina"), F.lit("}"))).otherwise(F.col("pagina"))
    page = F.from_json(wrapped, f"struct<data:array<{sources.RECORD}>>", {"mode": "FAILFAST"})
    rows = found.select("janela", "dia", F.explode(page["data"]).alias("r")).filter("r is not null")
    return rows.select("janela", "dia", *sources.contract_columns())


def ingest(spark: SparkSession, archive: str, path: str, start: dt.date, end: dt.date) -> list[str]:
    """Write the windows that have ended and are not in ``path`` yet; returns their first days.

    A window without contracts leaves no file and is looked at again by the next run. One ingest of a folder at a time.
    """
    over, done = closed(start, end), finished(path)
    todo = [a.isoformat() for a, _ in over if a.isoformat() not in done]
    if todo:
        spark.dataSource.register(WindowSink)
        rows = contracts(pages(spark, archive, start, over[-1][1], skip=done)).drop("dia")
        rows.write.format(WindowSink.name()).mode("append").option("path", path).save()
    return todo
