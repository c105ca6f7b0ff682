"""Landed pages as a Spark data source, in batch and as a stream.

``spark.read.format("landed_pages")`` reads one JSON envelope per file, a partition per
page: page, pos, page_rows (rows of the page) and the columns of the option ``row_ddl``.
Planning lists the files, starts at the page that holds ``offset``, ends with the one that
``limit`` needs or before the first missing page, and opens none of them. As a stream, an
offset is a page number: a trigger reads the pages that have landed since, up to the first
gap. Files must appear whole (written elsewhere and renamed), as with any file stream.

The page number is the last number of the file's name or, for a folder per page
(``page=7/part-0``), that of the folder."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

from .paging import assemble_pages

FORMAT = "landed_pages"


class Page(InputPartition):
    def __init__(self, number: int, files: list[str]):
        self.number, self.files = number, files


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_pages(path: str) -> dict[int, list[str]]:
    """Files of each page number under ``path``."""
    from pyarrow import fs

    system, root = _open(path)
    found: dict[int, list[str]] = {}
    for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
        name = f.path[len(root):].strip("/")
        if not f.is_file or any(part.startswith(("_", ".")) for part in name.split("/")):
            continue
        number = re.search(r"page=([0-9]+)/", name) or re.search(r"([0-9]+)\.json$", name)
        if number is None:
            raise ValueError(f"no page number in the name of {f.path}")
        found.setdefault(int(number[1]), []).append(f.path)
    return found


def run_of_pages(found: dict[int, list[str]], first: int, last: int | None = None) -> list[Page]:
    """Pages from ``first`` on, up to ``last`` or the first missing one."""
    out = []
    n = first
    while n in found and (last is None or n <= last):
        out.append(Page(n, sorted(found[n])))
        n += 1
    return out


def _value(v, kind, where: str):
    """A JSON value as a column of type ``kind``; one that does not fit fails."""
    if v is None:
        return None
    if isinstance(kind, StringType):
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    if isinstance(kind, (LongType, IntegerType)) and isinstance(v, int) and not isinstance(v, bool):
        return v
    if isinstance(kind, DoubleType) and isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    if isinstance(kind, BooleanType) and isinstance(v, bool):
        return v
    raise ValueError(f"{where}: {v!r} is no {kind.simpleString()}")


def read_page(path: str, schema: StructType, page: Page) -> Iterator[tuple]:
    """Rows of one page; a page that is not JSON fails, one without rows has none."""
    system, _ = _open(path)
    rows = []
    for file in page.files:
        with system.open_input_stream(file) as f:
            text = f.readall().decode("utf-8")
        try:
            rows += [r["row"] for r in json.loads(text).get("rows") or []]
        except (ValueError, KeyError, AttributeError, TypeError) as e:
            raise ValueError(f"damaged page {file}: {e}") from e
    fields = schema.fields[3:]
    for pos, row in enumerate(rows):
        yield (page.number, pos, len(rows), *[_value(row.get(f.name), f.dataType, f"page {page.number}") for f in fields])


class LandedPages(DataSource):
    """Options: path, row_ddl, and for batch reads page_size, limit and offset (rows)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "page long, pos long, page_rows long, " + self.options["row_ddl"]

    def reader(self, schema: StructType) -> DataSourceReader:
        size, offset = int(self.options.get("page_size", 100)), int(self.options.get("offset", 0))
        limit = self.options.get("limit")
        last = None if limit is None else (offset + int(limit) - 1) // size
        return PageReader(self.options["path"], schema, offset // size, last)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStream(self.options["path"], schema)


class PageReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, first: int, last: int | None):
        self.path, self.schema, self.first, self.last = path, schema, first, last

    def partitions(self) -> list[InputPartition]:
        # a source without partitions would be read as one: an empty page stands for none
        return run_of_pages(list_pages(self.path), self.first, self.last) or [Page(self.first, [])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return read_page(self.path, self.schema, partition)


class PageStream(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self, *_) -> dict:
        return {"page": len(run_of_pages(list_pages(self.path), 0))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return run_of_pages(list_pages(self.path), start["page"], end["page"] - 1)

    def read(self, partition: Page) -> Iterator[tuple]:
        return read_page(self.path, self.schema, partition)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)


def read_pages(spark: SparkSession, path: str, row_ddl: str, page_size: int, limit: int | None = None,
               offset: int = 0) -> DataFrame:
    """The rows that a sequential pager would have fetched (``paging.assemble_pages``), of
    which only the pages that ``offset`` and ``limit`` can need are opened."""
    register(spark)
    r = spark.read.format(FORMAT).option("row_ddl", row_ddl).option("page_size", page_size).option("offset", offset)
    if limit is not None:
        r = r.option("limit", limit)
    rows = r.load(path).drop("page_rows")
    return assemble_pages(rows, page_size, limit, offset)


def stream_pages(spark: SparkSession, path: str, row_ddl: str) -> DataFrame:
    """The pages of one feed as they land: page, pos, page_rows and the row's columns."""
    register(spark)
    return spark.readStream.format(FORMAT).option("row_ddl", row_ddl).load(path)
