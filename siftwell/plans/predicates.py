"""A parsed query as Column predicates over entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import metadata, scoring
from ..functions.bytesql import bytes_view
from .query import ANY, FILES, Query, Token
from .regex import name_pattern


def size_is(q: Query) -> Column:
    """Files only: any size filter rejects folders."""
    return ~F.col("is_dir") & F.col("size").between(*q.size)


def modified_is(q: Query, now: int) -> Column:
    low, high = q.age
    return F.col("mtime").between(max(0, now - high), max(0, now - low) if low <= now else 0)


def type_is(q: Query) -> Column:
    named = [t for t in sorted(q.types) if t not in ("dir", "none")]
    out = F.lit(False)
    if FILES <= q.types:
        out = ~F.col("is_dir")
    elif named:
        out = ~F.col("is_dir") & F.coalesce(F.col("category").isin(named), F.lit(False))
    return out | F.col("is_dir") if "dir" in q.types else out


def kind_is(q: Query) -> Column:
    return {"file": ~F.col("is_dir") & ~F.col("is_link"), "dir": F.col("is_dir"), "link": ~F.col("is_dir") & F.col("is_link")}[q.kind]


def ext_is(q: Query, name: Column) -> Column:
    return F.coalesce(metadata.extension(name).isin(list(q.exts)), F.lit(False))


def in_scope(q: Query, root: str) -> Column:
    """Strict descendants; pushed down as a prefix."""
    return F.col("path") != root if q.scope == root else F.col("path").startswith(q.scope.rstrip("/") + "/")


def entry_filter(q: Query, root: str, now: int) -> Column:
    """All but words; cheap tests first."""
    out = F.col("path") != root
    if q.size:
        out = out & size_is(q)
    if q.age:
        out = out & modified_is(q, now)
    if q.types != ANY:
        out = out & type_is(q)
    if q.kind != "any":
        out = out & kind_is(q)
    if q.scope:
        out = out & in_scope(q, root)
    if q.exts:
        out = out & ext_is(q, F.col("name"))
    if q.name_re:
        out = out & F.col("name").rlike(name_pattern(q.name_re))
    if q.path_re:
        out = out & F.col("path").rlike(name_pattern(q.path_re))
    return out


def _test(t: Token):
    return lambda n: scoring.token_matches(bytes_view(n), t.mode, t.text)


def _scored(t: Token):
    return lambda n: score_of(t, n).isNotNull()


def rejected(q: Query, names: Column) -> Column:
    """A negated word matches one of these names."""
    out = F.lit(False)
    for t in q.negative:
        out = out | F.exists(names, _test(t))
    return out


def score_of(t: Token, name: Column) -> Column:
    return scoring.token_score(bytes_view(name), t.mode, t.text)


def path_filter(q: Query, path: Column, home_category: bool = True) -> Column:
    """For content search: words match any component of the path, none needs to match the name itself."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.substring_index(path, "/", -1)
    out = F.lit(True)
    if q.exts:
        out = out & ext_is(q, name)
    if q.types != ANY:
        kinds = [t for t in sorted(q.types) if t not in ("dir", "none")]
        out = out & (F.lit(FILES <= q.types) | F.coalesce(metadata.category(name).isin(kinds), F.lit(False)))
    if q.name_re:
        out = out & name.rlike(name_pattern(q.name_re))
    if q.path_re:
        out = out & path.rlike(name_pattern(q.path_re))
    for t in q.positive:
        out = out & F.exists(parts, _scored(t))
    return out & ~rejected(q, parts) if q.negative else out
