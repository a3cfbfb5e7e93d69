"""Places that driver and executors share, and small helpers on sessions and frames."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import open_fs, shared_dir, shared_root, stored  # noqa: F401


#: Rows of a table that may be broadcast, a key and a few numbers each: some 5 MB.
BROADCAST_ROWS = 50_000
#: A key is hot from this part of all rows on, so that there are at most as many hot keys.
HOT_PART = 256


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column is called so."""
    have = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def with_fields(df: DataFrame, columns: list[str], *more: tuple[str, str]) -> T.StructType:
    """The schema of columns of a frame and further ones as (name, type)."""
    return T.StructType([*(df.schema[c] for c in columns), *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in more)])


def joined(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """left with the columns of right, a stored table with a row for a key and, as weight, how many rows of left have it.

    A small table is broadcast. Of a larger one, the hot keys (fewer than HOT_PART, by their weights) are, so that no
    shuffled key holds more than that part of the rows.
    """
    rows, total = right.agg(F.count("*"), F.sum(weight)).first()
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), key, how)
    hot = F.col(weight) > total / HOT_PART
    top = right.where(hot).drop(weight)
    rest = left.join(F.broadcast(top.select(key)), key, "left_anti").join(right.where(~hot).drop(weight), key, how)
    return left.join(F.broadcast(top), key).unionByName(rest)


def put_bytes(uri: str, data: bytes) -> None:
    """Write a whole file under its final name only when complete, so that a repeated task is harmless."""
    system, path = open_fs(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def map_bytes(uri: str) -> memoryview:
    """Memory-map a shared file. From a store that cannot be mounted, a nameless local copy is mapped."""
    system, path = open_fs(uri)
    if isinstance(system, pafs.LocalFileSystem):
        return memoryview(pa.memory_map(path).read_buffer())
    with system.open_input_stream(path) as src, tempfile.NamedTemporaryFile() as copy:
        shutil.copyfileobj(src, copy)
        copy.flush()
        return memoryview(pa.memory_map(copy.name).read_buffer())


def frame_bytes(df: DataFrame, column: str) -> int:
    """About how many bytes the frame holds: Catalyst's statistics, or a count where these know nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return size


def power_of_two(n: float, low: int) -> int:
    k = low
    while k < n:
        k *= 2
    return k


def single_threaded() -> None:
    """Workers share the cores of an executor: no thread pools inside them."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    pa.set_cpu_count(1)
