"""Content search: literal and regular-expression grep over documents (path, size, mtime, text)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metadata
from ..functions.bytesql import fold, fold_text
from ..plans import predicates, regex
from ..plans.query import Query, parse

LIMIT, PER_FILE = 50, 5
FALLBACK_FILES = 200_000


@dataclass(frozen=True)
class Grep:
    pattern: str
    mode: str = "literal"

    def problem(self) -> str:
        if not self.pattern:
            return "grep needs a pattern"
        return regex.problem(self.pattern) if self.mode == "regex" else ""

    def matches(self, text: Column) -> Column:
        """Whether a whole text matches; matches may cross lines."""
        if self.mode == "regex":
            return text.rlike(regex.text_pattern(self.pattern))
        if regex.smart_case(self.pattern):
            return F.contains(text, F.lit(self.pattern))
        return F.contains(fold(text), F.lit(fold_text(self.pattern)))

    def by_line(self) -> bool:
        """Whether lines can be tested one by one."""
        return "\n" not in self.pattern if self.mode == "literal" else regex.within_lines(self.pattern)


def candidate_order() -> list[Column]:
    return [F.desc("rank"), F.desc("mtime"), F.asc("path")]


def candidates(content: DataFrame, q: Query, now: int, root: str = "/") -> DataFrame:
    """Documents that the query's filters leave, with their order tier. All filters count, sizes and times too."""
    out = content.withColumn("rank", metadata.doc_rank(F.col("path")))
    if q.scope:
        out = out.where(predicates.in_scope(q, root))
    if q.size:
        out = out.where(F.col("size").between(*q.size))
    if q.age:
        out = out.where(predicates.modified_is(q, now))
    if q.kind == "dir":
        out = out.limit(0)
    return out.where(predicates.path_filter(q, F.col("path")))


def _lines(pattern: str, per_file: int):
    """Matching lines of whole texts, for patterns that may cross lines or be empty."""
    caseless = not regex.smart_case(pattern)
    body = re.sub(r"\[:(\w+):\]", lambda m: {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "space": r"\s", "upper": "A-Z", "lower": "a-z"}.get(m[1], ""), pattern)
    found = re.compile(body, re.M | (re.I if caseless else 0))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([first_lines(found, t, per_file) for t in texts])

    return F.pandas_udf(run, "array<int>")


def first_lines(found: re.Pattern, text: str | None, per_file: int) -> list[int]:
    """Numbers of the lines in which matches begin, each once."""
    out, at, line, counted = [], 0, 1, 0
    text = text or ""
    while len(out) < per_file and at <= len(text) and (m := found.search(text, at)):
        line += text.count("\n", counted, m.start())
        counted = m.start()
        out.append(line)
        end = text.find("\n", m.start())
        end = len(text) if end < 0 else end
        at = max(end + 1, m.start() + 1 if m.end() == m.start() else m.end())
    return out


def matching_lines(docs: DataFrame, g: Grep, per_file: int) -> DataFrame:
    """docs (which match) with ``lines``: the first per_file of them as (line, text), trimmed."""
    lines = F.split("text", "\n")
    if g.by_line():
        # split leaves an empty line after a final line feed, which isn't one
        numbered = F.transform(lines, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
        hit = F.filter(numbered, lambda s: g.matches(s["text"]) & ((s["text"] != "") | (s["line"] < F.size(lines))))
        return docs.withColumn("lines", F.transform(F.slice(hit, 1, per_file), lambda s: F.struct(s["line"].alias("line"), metadata.trim_line(s["text"]).alias("text"))))
    if g.mode == "literal":
        pattern = re.escape(g.pattern)
    else:
        pattern = g.pattern
    numbers = docs.withColumn("_at", _lines(pattern, per_file)("text"))
    return numbers.withColumn("lines", F.transform("_at", lambda i: F.struct(i.alias("line"), metadata.trim_line(F.coalesce(F.get(lines, i - 1), F.lit(""))).alias("text")))).drop("_at")


def grep(content: DataFrame, pattern: str, mode: str = "literal", query: str | Query = "", now: int = 0, root: str = "/", home: str = "/", limit: int = LIMIT, per_file: int = PER_FILE) -> DataFrame:
    """(path, lines) of the first matching files in order, with their rank among the hits."""
    g = Grep(pattern, mode)
    if why := g.problem():
        raise ValueError(why)
    q = parse(query, home) if isinstance(query, str) else query
    hits = candidates(content, q, now, root).where(g.matches(F.col("text")))
    first = hits.orderBy(*candidate_order()).limit(limit)
    with_lines = matching_lines(first, g, max(1, per_file))
    return with_lines.select("path", "lines", F.row_number().over(W.orderBy(*candidate_order())).alias("ord"))


def counters(content: DataFrame, g: Grep, q: Query, now: int, root: str = "/", limit: int = LIMIT) -> DataFrame:
    """One row: candidates, files read (all, in a batch) and hits."""
    found = candidates(content, q, now, root)
    return found.agg(F.count("*").alias("candidates"), F.count("*").alias("read"), F.count_if(g.matches(F.col("text"))).alias("hits"), F.lit(True).alias("complete"))
