"""Ranked name search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metadata
from ..plans import predicates
from ..plans.query import Query, Token, parse

LIMIT = 50
TRACKED = 4  # words whose best folder score counts; later ones add a constant
LOW, HIGH = -32768, 32767


@dataclass(frozen=True)
class Hits:
    """All matches with their scores (lazy), and the first ones in order."""

    all: DataFrame
    top: DataFrame

    def total(self) -> int:
        return self.all.count()


def own_scores(tokens: tuple[Token, ...], name: Column) -> list[Column]:
    return [predicates.score_of(t, name) for t in tokens]


def folder_scores(t: Token, folders: Column) -> Column:
    """The best score of the folders above; null if none matches."""
    return F.array_max(F.transform(folders, lambda f: predicates.score_of(t, f)))


def score(df: DataFrame, q: Query, now: int) -> DataFrame:
    """df with ``score`` for the rows that the words match; the other filters have been applied."""
    tokens = q.positive
    name = F.col("name")
    # folders are only looked at when there are several words: a single one must be in the name
    held = df.select("*", *(c.alias(f"_s{i}") for i, c in enumerate(own_scores(tokens, name))))
    total = F.lit(0)
    if tokens:
        any_own = F.lit(False)
        for i in range(len(tokens)):
            any_own = any_own | F.col(f"_s{i}").isNotNull()
            total = total + F.coalesce(F.col(f"_s{i}"), F.lit(0))
        held = held.where(any_own)
    total = F.least(F.lit(HIGH), F.greatest(F.lit(LOW), total))
    if len(tokens) > 1:
        held = held.select("*", *(F.when(F.col(f"_s{i}").isNull(), folder_scores(t, F.col("folders"))).alias(f"_f{i}") for i, t in enumerate(tokens)))
        for i in range(len(tokens)):
            held = held.where(F.col(f"_s{i}").isNotNull() | F.col(f"_f{i}").isNotNull())
            add = F.floor(F.greatest(F.col(f"_f{i}"), F.lit(0)) * 3 / 4).cast("int") if i < TRACKED else F.lit(ANCESTOR)
            total = total + F.when(F.col(f"_s{i}").isNull(), add).otherwise(0)
    if q.negative:
        held = held.where(~predicates.rejected(q, F.concat(F.col("folders"), F.array(name))))
    tweaks = metadata.rank_tweaks(name, F.col("hidden"), F.col("is_dir") | F.col("is_link"), F.col("mtime"), now)
    held = held.withColumn("score", (total + F.col("prior") + tweaks).cast("int"))
    return held.drop(*(f"_s{i}" for i in range(len(tokens))), *(f"_f{i}" for i in range(len(tokens)) if len(tokens) > 1))


ANCESTOR = 6


def rank_order() -> list[Column]:
    """Score, then folders as a depth-first walk meets them, folders before files, names; the path decides last."""
    return [F.desc("score"), F.asc("order_key"), F.desc("is_dir"), F.asc(metadata.is_hex_name(F.col("name"))), F.asc("name"), F.asc("path")]


def matches(entries: DataFrame, q: Query, root: str, now: int) -> DataFrame:
    if not q.selects():
        return score(entries.limit(0), q, now)
    return score(entries.where(predicates.entry_filter(q, root, now)), q, now)


def search(entries: DataFrame, text: str | Query, root: str, now: int, limit: int | None = None, home: str = "/") -> Hits:
    """limit: overrides the query's own; 0 gives no hits (but a total), None the query's or the default."""
    q = parse(text, home) if isinstance(text, str) else text
    found = matches(entries, q, root, now)
    k = limit if limit is not None else q.limit if q.limit is not None else LIMIT
    hits = found.select("path", F.col("is_dir").alias("dir"), "size", "mtime", "score", "order_key", "is_dir", "name")
    return Hits(found, hits.orderBy(*rank_order()).limit(k).select("path", "dir", "size", "mtime", "score"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k matches with their place, from 1. The limit goes first, so that one small task numbers them."""
    first = found.orderBy(*rank_order()).limit(k)
    return first.withColumn("rank", F.row_number().over(W.orderBy(*rank_order())))


def overlaid(base: DataFrame, dead: DataFrame, extras: DataFrame) -> DataFrame:
    """base without dead paths and with extras in place of equal paths; ``is_extra`` tells them apart."""
    gone = dead.select("path").unionByName(extras.select("path"))
    return base.join(gone, "path", "left_anti").withColumn("is_extra", F.lit(False)).unionByName(extras.withColumn("is_extra", F.lit(True)))


def subtree_counts(entries: DataFrame, root: str) -> DataFrame:
    """How many entries lie below each folder."""
    base = "" if root == "/" else root
    chain = F.transform(F.sequence(F.lit(1), F.size("folders")), lambda i: F.concat(F.lit(f"{base}/"), F.array_join(F.slice("folders", 1, i), "/")))
    return entries.where(F.size("folders") > 0).select(F.explode(chain).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def name_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("is_dir", "name").agg(F.count("*").alias("n"))


def by_name(entries: DataFrame, q: Query) -> DataFrame:
    """Entries whose name has all words, with each distinct name scored once and joined back: worth it where names repeat much."""
    names = entries.select("name").distinct()
    scored = names.select("name", *(c.alias(f"s{i}") for i, c in enumerate(own_scores(q.positive, F.col("name")))))
    for i in range(len(q.positive)):
        scored = scored.where(F.col(f"s{i}").isNotNull())
    return entries.join(scored, "name")


def folder_hits(entries: DataFrame, q: Query) -> DataFrame:
    """(path, words, best): which words the folders above an entry match (as bits) and the best scores, by a join with the folders that match."""
    folders = entries.where("is_dir").select("path", "name")
    scores = own_scores(q.positive, F.col("name"))
    bits = sum((F.when(s.isNotNull(), 1 << i).otherwise(0) for i, s in enumerate(scores)), F.lit(0))
    hit = folders.select(F.col("path").alias("folder"), bits.cast("int").alias("bits"), F.array(*(F.coalesce(s, F.lit(0)) for s in scores)).alias("scores")).where("bits > 0")
    chain = F.transform(F.sequence(F.lit(1), F.size(F.split("parent", "/")) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(F.split("parent", "/"), 2, i), "/")))
    above = entries.select("path", F.explode(chain).alias("folder"))
    return above.join(hit, "folder").groupBy("path").agg(F.bit_or("bits").alias("words"), *(F.max(F.col("scores")[i]).alias(f"best{i}") for i in range(len(scores))))
