"""A source of numbered pages of records, read in parallel as a table or page by page as a stream."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "paged"
PAGE = re.compile(r"(?:^|/)page=(\d+)/(?!\.|_)[^/]*$")


@dataclass
class Pages(InputPartition):
    """Files of one or more pages, in the order of their numbers."""

    files: tuple[tuple[int, str], ...]


class _Folder:
    """The pages below a folder: `page=<number>/<any file>`, each line of a file one JSON object with a list `items`."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.fields = options["path"], [f.name for f in schema]
        self.per_partition = max(1, int(options.get("pagesperpartition", "8")))

    def listed(self, first: int = 0, end: int | None = None) -> list[tuple[int, str]]:
        """(number, file) of the pages from `first` up to and without `end`; a folder that is not there has none."""
        where, root = fs.FileSystem.from_uri(self.path)
        infos = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        found = [(int(m[1]), i.path) for i in infos if i.is_file and (m := PAGE.search(i.path))]
        return sorted((n, p) for n, p in found if first <= n and (end is None or n < end))

    def partitions(self, files: list[tuple[int, str]]) -> list[Pages]:
        return [Pages(tuple(files[k : k + self.per_partition])) for k in range(0, len(files), self.per_partition)]

    def read(self, pages: Pages) -> Iterator[tuple]:
        where, _ = fs.FileSystem.from_uri(self.path)
        for _, path in pages.files:
            with where.open_input_stream(path) as source:
                text = source.read().decode()
            for line in text.split("\n"):
                for item in json.loads(line).get("items", []) if line.strip() else []:
                    yield tuple(item.get(name) for name in self.fields)


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def partitions(self) -> list[Pages]:
        return self.folder.partitions(self.folder.listed()) or [Pages(())]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.folder.read(partition)


class _Stream(DataSourceStreamReader):
    """The offset is the number of the next page; a page is complete once its file is there under its name."""

    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        files = self.folder.listed()
        return {"page": files[-1][0] + 1 if files else 0}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.folder.partitions(self.folder.listed(start["page"], end["page"])) or [Pages(())]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.folder.read(partition)


class PagedSource(DataSource):
    """`spark.read.format("paged").schema(...).load(path)`, and the same with `readStream`.

    `path` is an address that pyarrow opens and every executor reaches. A field that an item lacks is null, one that the
    schema lacks is left out. Pages are read by groups of `pagesPerPartition`, whole page by whole page. A stream takes
    pages by rising numbers: one that comes after a higher one has been read is not seen any more.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        raise ValueError("a schema must be given")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_Folder(self.options, schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Folder(self.options, schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
