"""The symbol table: extraction from sources, search, location and incremental upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import metadata
from ..functions.bytesql import fold
from ..functions.symbols import extract
from ..plans.query import Query, parse
from . import search

SOURCE_BYTES = 1 << 20
TABLE = "path string, name string, line int, kind string"


def sources(content: DataFrame) -> DataFrame:
    """Rows (path, size, text) that symbols are read from: a known language, at most 1 MiB, not minified."""
    named = content.withColumn("lang", metadata.language(F.substring_index("path", "/", -1)))
    return named.where(F.col("lang").isNotNull() & (F.col("size") <= SOURCE_BYTES) & ~metadata.minified(F.col("text")))


def _extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        found = [(p, s.name, s.line, s.kind) for p, lang, t in zip(rows["path"], rows["lang"], rows["text"], strict=True) for s in extract(t or "", lang)]
        yield pd.DataFrame(found, columns=["path", "name", "line", "kind"])


def build(content: DataFrame) -> DataFrame:
    """(path, name, line, kind) of all definitions; a name once a file."""
    return sources(content).select("path", "lang", "text").mapInPandas(_extract, TABLE)


@udtf(returnType="name: string, line: int, kind: string")
class ExtractSymbols:
    """extract_symbols(text, language) for SQL."""

    def eval(self, text: str, lang: str):
        yield from extract(text or "", lang)


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_symbols", ExtractSymbols)


def first_definitions(symbols: DataFrame) -> DataFrame:
    """The first of each name in a file, from any table of definitions."""
    own = W.partitionBy("path", "name").orderBy("line", "kind")
    return symbols.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")


def matches(symbols: DataFrame, entries: DataFrame, q: Query, root: str, now: int) -> DataFrame:
    """Symbols that contain all terms, in the files that the rest of the query selects."""
    for term in q.syms:
        symbols = symbols.where(F.contains(fold(F.col("name")), F.lit(term)))
    if not q.syms:
        return symbols.limit(0)
    if q.selects():
        files = search.matches(entries.where("not is_dir"), q, root, now).select("path")
        symbols = symbols.join(files, "path", "left_semi")
    return symbols


def find(symbols: DataFrame, entries: DataFrame, text: str, root: str, now: int, limit: int = search.LIMIT, home: str = "/") -> DataFrame:
    """The first matches by name (bytewise), then by file."""
    found = matches(symbols, entries, parse(text, home), root, now).withColumn("_file", F.substring_index("path", "/", -1))
    order = [F.asc("name"), F.asc(metadata.is_hex_name(F.col("_file"))), F.asc("_file"), F.asc("path")]
    top = found.orderBy(*order).limit(limit)
    return top.select("path", "line", F.col("name").alias("symbol"), "kind", F.row_number().over(W.orderBy(*order)).alias("rank"))


def locate(hits: DataFrame, content: DataFrame) -> DataFrame:
    """hits (path, name) with line and kind from the texts as they are now; line 0 and kind ? where a definition is gone."""
    wanted = content.join(hits.select("path").distinct(), "path", "left_semi")
    now = first_definitions(build(wanted)).select("path", "name", "line", "kind")
    return hits.select("path", "name").join(now, ["path", "name"], "left").select("path", "name", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("kind", F.lit("?")).alias("kind"))


def fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", F.xxhash64("path", "size", "mtime"))


def update(symbols: DataFrame, known: DataFrame, content: DataFrame) -> DataFrame:
    """The table after changes. known: (path, fingerprint) of the files it was built from; only others are read."""
    now = fingerprint(content)
    same = now.select("path", "fingerprint").join(known.select("path", "fingerprint"), ["path", "fingerprint"], "left_semi")
    fresh = now.join(same, "path", "left_anti").drop("fingerprint")
    return symbols.join(same.select("path"), "path", "left_semi").select("path", "name", "line", "kind").unionByName(build(fresh))
