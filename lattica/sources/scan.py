"""Sources as a table. Spark's own text readers skip names that begin with "_" or ".", so this is a data source of its own."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattica.sources.project_files import ProjectError, listed

#: Files that one task reads.
TOGETHER = 64


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[_Files]:
        files = list(enumerate(listed(self.root)))
        return [_Files(files[k : k + TOGETHER]) for k in range(0, len(files), TOGETHER)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for n, path in partition.files:
            with open(path, encoding="utf-8", errors="replace") as f:
                yield n, path, f.read()


class SourceTree(DataSource):
    """spark.read.format("source_tree").load(root): id (scan order), path, content. The tree must be readable on all executors."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "id long, path string, content string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def sources(spark: SparkSession, root: str) -> DataFrame:
    root = os.path.abspath(root).replace(os.sep, "/")
    if not os.path.exists(root):
        raise ProjectError(f'Path "{root}" does not exist.')
    if not os.path.isdir(root):
        raise ProjectError(f'Path "{root}" is not a directory.')
    if not listed(root):
        raise ProjectError(f'No source files found in "{root}".')
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").load(root)
