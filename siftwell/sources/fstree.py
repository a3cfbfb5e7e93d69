"""A Spark data source over a directory tree: spark.read.format("fstree").option("root", ...).

One partition for each top folder; symbolic links aren't followed; unreadable folders are empty;
excluded folders are entries without children.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.entries import EXCLUDED

SCHEMA = "path string, is_dir boolean, is_link boolean, hidden boolean, size long, mtime long, mtime_ns long"


def row(path: str, st: os.stat_result) -> tuple:
    folder = stat.S_ISDIR(st.st_mode)
    return (path, folder, stat.S_ISLNK(st.st_mode), os.path.basename(path).startswith("."), 0 if folder else st.st_size, max(0, int(st.st_mtime)), st.st_mtime_ns)


def list_folder(path: str) -> list[tuple] | None:
    """Rows of one folder's files, folders and links; None if it can't be read."""
    out = []
    try:
        with os.scandir(path) as found:
            for entry in found:
                try:
                    st = entry.stat(follow_symlinks=False)
                except OSError:
                    continue
                if stat.S_ISDIR(st.st_mode) or stat.S_ISREG(st.st_mode) or stat.S_ISLNK(st.st_mode):
                    out.append(row(os.path.join(path, entry.name), st))
    except OSError:
        return None
    return out


def excluded(root: str) -> frozenset[str]:
    return frozenset(EXCLUDED) if root == "/" else frozenset()


def walk(path: str, skip: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """All below a folder, a folder before what it holds."""
    todo = [path]
    while todo:
        for r in list_folder(todo.pop()) or []:
            yield r
            if r[1] and r[0] not in skip:
                todo.append(r[0])


@dataclass
class Part(InputPartition):
    path: str
    deep: bool


class Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/") or "/"

    def partitions(self) -> list[Part]:
        top = [r[0] for r in list_folder(self.root) or [] if r[1] and r[0] not in excluded(self.root)]
        return [Part(self.root, False), *(Part(p, True) for p in sorted(top))]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.deep:
            yield from walk(part.path, excluded(self.root))
        else:
            yield from list_folder(part.path) or []


class FsTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fstree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["root"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FsTree)
