"""URL filter: rules first, then the ratio of two character language models.

Two variable-order Markov models (accepted, rejected) count every byte after each of its last 0 to
ORDER - 1 bytes, exactly, in one pass: grams are numbers, counted in Spark and written as sorted arrays
in shards of the shared folder, which scoring workers memory-map; the driver gets one number per shard.
Probabilities are smoothed by Witten and Bell's interpolation down to a uniform byte. A URL's
number is the difference of the log-likelihoods divided by its length; it is rejected above a
threshold that is calibrated on accepted URLs kept out of the counts, so that at most FALSE_ALARMS
of these are lost.

The accepted model learns from the URLs that rules allow and, as most are fine, from those that no rule
decides: a model that has seen too little finds all that is new unlikely. Bad hosts are known by their words.
Some are given (seeds); the others are learnt from the rules' own verdicts: a word of a host that rules block at
least twice as often as hosts are blocked at all, beyond chance, marks bad ones (the domain that a rule names
doesn't count, as every URL under it has that). The rejected model learns from hosts made of seed words and from
blocked and undecided URLs of hosts with a marking word; no host with such a word is an example of an accepted one.
Other blocked URLs are a site's policy (a language, a folder), which says nothing about other sites;
``learn_blocked`` makes them examples too.

Cases: a null URL or one without :// has an empty host and path, fits no rule, holds no evidence and
is allowed; repeated rows are judged alike; with no rejected example all undecided URLs are allowed;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .words import mix

ORDER = 5
#: Digits of a gram: a byte plus 1, and 0 before the URL.
BASE = 257
#: Distinct grams that a worker holds before it sends them, and for which one shard is made.
FLUSH, SHARD_GRAMS = 1 << 21, 1 << 20
FALSE_ALARMS = 0.01
#: Blocked URLs that a host's word must occur in to mark bad ones.
PROOFS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words of hosts that sell or harm.
SEEDS = ("adult", "bets", "betting", "bonus", "casino", "cheap", "escort", "farm", "free", "jackpot", "loans", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx")


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: tuple[str, str, str], h: Column, p: Column) -> Column:
    return ((h == rule[1]) | h.endswith(f".{rule[1]}")) & p.startswith(rule[2])


def rule_of(rules: Sequence[tuple[str, str, str]], h: Column, p: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0])):
        fit = fits(r, h, p)
        name = F.when(fit, r[1] + r[2]) if name is None else name.when(fit, r[1] + r[2])
        verdict = F.when(fit, r[0]) if verdict is None else verdict.when(fit, r[0])
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def seed_urls(seeds: Sequence[str] = SEEDS) -> list[str]:
    """Begins of hosts; no domain follows, so that none counts as evidence."""
    return [f"{a}-{b}." for a in seeds for b in seeds if a != b]


def _grams(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every byte its gram of each order (a column for each), and the URLs' offsets. A gram is a number of
    digits below BASE (order, context, byte; a digit 0 is before the URL), so that no two grams are the same."""
    data, offsets = words.columns(urls)
    n = len(data)
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros((n, ORDER), np.int64)
    digit = data.astype(np.int64) + 1
    context = np.zeros(n, np.int64)
    for k in range(ORDER):
        if k:
            byte = np.zeros(n, np.int64)
            byte[k:] = digit[: max(0, n - k)]
            byte[np.arange(n) - k < begin] = 0  # before the URL
            context = context + byte * BASE ** (k - 1)
        out[:, k] = (k * BASE**ORDER) + context * BASE + digit
    return out, offsets


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts[order], at, axis=0) if len(at) else counts[:0]


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, accepted, rejected): how often a gram occurs in either class, a row for a gram and FLUSH grams held."""
    shared.single_threaded()
    keys, counts = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    out = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy())], ["gram", "accepted", "rejected"])
    for rb in words.batches(rows, "url", 1 << 20):
        grams, offsets = _grams(rb.column(0))
        rejected = np.repeat(np.asarray(rb.column(1)), np.diff(offsets)).astype(bool)
        for k in (0, 1):
            uniq, n = np.unique(grams[rejected == bool(k)], return_counts=True)
            both = np.zeros((len(uniq), 2), np.int64)
            both[:, k] = n
            keys, counts = _merge(np.concatenate([keys, uniq]), np.concatenate([counts, both]))
        if len(keys) >= FLUSH:
            yield out()
            keys, counts = keys[:0], counts[:0]
    yield out()


def shards_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the contexts, each of which has at most 256 grams."""
    return (mix(grams // BASE) & np.uint64(shards - 1)).astype(np.int32)


def _deal(shards: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        for rb in rows:
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(shards_of(np.asarray(rb.column(0)), shards))], [*rb.schema.names, "shard"])

    return run


def _write(folder: str):
    """A shard's grams and, as all grams of a context are in one shard, its contexts with totals and kinds."""

    def run(table: pa.Table) -> pa.Table:
        shared.single_threaded()
        keys, counts = _merge(np.asarray(table.column("gram")), np.column_stack([np.asarray(table.column(c)) for c in ("accepted", "rejected")]))
        contexts = keys // BASE
        at = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
        totals, kinds = np.add.reduceat(counts, at, axis=0), np.add.reduceat((counts > 0).astype(np.int64), at, axis=0)
        shard = table.column("shard")[0].as_py()
        parts = [np.array([len(keys), len(at)]), keys, *counts.T, contexts[at], *totals.T, *kinds.T]
        shared.put_bytes(f"{folder}/grams-{shard}", b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in parts))
        return pa.table([pa.array([shard], pa.int32())], names=["shard"])

    return run


def train(spark: SparkSession, labelled: DataFrame) -> dict:
    """labelled: (url string, rejected int). Writes the exact counts of all grams; the model: their folder and shards."""
    rows = labelled.select(F.coalesce("url", F.lit("")).alias("url"), F.col("rejected").cast("int").alias("rejected"))
    counted = rows.mapInArrow(_count, "gram long, accepted long, rejected long").groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    counted = shared.stored(spark, counted, "counted")
    folder = shared.shared_dir(spark, "grams")
    shards = shared.power_of_two(counted.count() / SHARD_GRAMS, 8)
    dealt = counted.mapInArrow(_deal(shards), "gram long, accepted long, rejected long, shard int")
    written = dealt.groupBy("shard").applyInArrow(_write(folder), "shard int").collect()  # a number for each shard
    return {"folder": folder, "shards": shards, "written": {r["shard"] for r in written}}


class Markov:
    """The counts of both classes, mapped shard by shard when first needed."""

    def __init__(self, meta: dict):
        self.meta, self.mapped = meta, {}

    def _arrays(self, shard: int) -> list[np.ndarray]:
        if shard not in self.mapped:
            raw = np.frombuffer(shared.map_bytes(f"{self.meta['folder']}/grams-{shard}"), np.int64)
            n, m = raw[:2].tolist()
            self.mapped[shard] = np.split(raw[2:], np.cumsum([n, n, n, m, m, m, m]))
        return self.mapped[shard]

    def counts(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of distinct grams, and totals and kinds of their contexts; a row for either class."""
        out = np.zeros((3, 2, len(grams)))
        shard = shards_of(grams, self.meta["shards"])
        for k in np.unique(shard).tolist():
            if k in self.meta["written"]:
                keys, *n, contexts, total0, total1, kinds0, kinds1 = self._arrays(k)
                at = np.flatnonzero(shard == k)
                for ordered, wanted, into in ((keys, grams[at], ((0, n),)), (contexts, grams[at] // BASE, ((1, (total0, total1)), (2, (kinds0, kinds1))))):
                    place = np.searchsorted(ordered, wanted)
                    place[place == len(ordered)] = 0
                    hit = ordered[place] == wanted
                    for i, values in into:
                        for c in (0, 1):
                            out[i, c, at[hit]] = values[c][place[hit]]
        return out[0], out[1], out[2]

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of every byte, a row for either class."""
        uniq, back = np.unique(grams, return_inverse=True)
        back = back.reshape(grams.shape)
        counts, totals, kinds = self.counts(uniq)
        p = np.full((2, len(grams)), 1 / 256)
        for k in range(ORDER):
            at = back[:, k]
            total, kind = totals[:, at], kinds[:, at]
            p = np.where(total > 0, (counts[:, at] + kind * p) / np.maximum(total + kind, 1), p)
        return np.log(p)

    def ratios(self, urls: pa.Array) -> np.ndarray:
        """Mean log-likelihood ratio a byte: positive where the rejected model fits better; 0 for empty URLs."""
        grams, offsets = _grams(urls)
        length = np.diff(offsets)
        if not len(grams):
            return np.zeros(len(length))
        logs = self.logs(grams)
        sums = np.concatenate([[0.0], np.cumsum(logs[1] - logs[0])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(length, 1)


def ratios(model: dict, urls: pa.Array) -> np.ndarray:
    return Markov(model).ratios(urls)


def _ratio(model: dict):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        markov = Markov(model)
        for rb in words.batches(rows, "url", 1 << 20):
            columns = [*rb.columns[1:], pa.array(markov.ratios(rb.column(0)))]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return run


def score(urls: DataFrame, model: dict) -> DataFrame:
    """urls with a column ``ratio`` (underscores follow where there is one); the models read a host and path. model: what train() returns."""
    (name,) = shared.fresh(urls.columns, "ratio")
    rows = urls.select(F.coalesce("url", F.lit("")).alias("url"), *(shared.quoted(c).alias(f"c{i}") for i, c in enumerate(urls.columns)))
    return rows.mapInArrow(_ratio(model), shared.with_fields(urls, urls.columns, (name, "double")))


def marked(spark: SparkSession, judged: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Ids of rows of judged (id, host, ruled) whose hosts have a word that rules block beyond chance."""
    ends = "|".join(sorted({re.escape(h) for _, h, _ in rules}, key=len, reverse=True))
    own = F.regexp_replace("host", rf"(^|\.)({ends})$", "") if ends else F.col("host")
    rows = judged.select("id", (F.col("ruled") == "block").alias("bad"), F.explode(F.array_distinct(F.split(own, "[.-]+"))).alias("word")).where("length(word) >= 3")
    total = judged.agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad")).first()
    rate = total["bad"] / max(1, total["n"])
    counts = rows.groupBy("word").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).where(f"bad >= {PROOFS} AND bad >= 2 * n * {rate!r}")
    n, b = F.col("n"), F.col("bad")
    term = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)
    gain = 2 * (term(b, n * rate) + term(n - b, n * (1 - rate)))  # log-likelihood ratio against chance
    counts = shared.stored(spark, counts.select("word", "n", gain.alias("gain")), "host-words")
    least = 2 * math.log(max(1, counts.count()) / 0.01)
    return shared.joined(rows.select("id", "word"), counts.where(F.col("gain") >= least).select("word", "n"), "word", "n").select("id").distinct()


def filter_urls(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS, false_alarms: float = FALSE_ALARMS, learn_blocked: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict and the models' ratio."""
    h, p = host(F.col("url")), path(F.col("url"))
    name, verdict = rule_of(rules, h, p)
    judged = pages.select("page_id", F.concat(h, p).alias("url"), h.alias("host"), p.alias("path"), name.alias("rule"), verdict.alias("ruled"), F.monotonically_increasing_id().alias("id"))
    judged = shared.stored(spark, judged, "urls")
    with_words = marked(spark, judged, rules).withColumn("learnt", F.lit(True))
    named = F.col("host").rlike(f"(^|[.-])({'|'.join(seeds)})([.-]|$)") if seeds else F.lit(False)
    named = named | F.coalesce("learnt", F.lit(False))
    blocked = F.coalesce(F.col("ruled") == "block", F.lit(False))
    free = F.col("ruled").isNull() & (F.col("url") != "")
    example = F.when(blocked, named | F.lit(learn_blocked)).when(free, F.lit(True)).otherwise(~named & (F.col("url") != ""))
    decided = judged.join(with_words, "id", "left").where(example).select("url", (blocked | free & named).cast("int").alias("rejected"))
    decided = shared.stored(spark, decided, "decided")
    kept_out = (F.col("rejected") == 0) & (F.pmod(F.xxhash64("url"), F.lit(10)) == 0)
    # seeds are shown often enough to weigh as much as the rules' own rejections do, at any size
    n = decided.where("rejected = 1").count()
    own = seed_urls(seeds)
    times = max(1, n // max(1, len(own)))
    learnt = decided.where(~kept_out)
    if own:
        sown = spark.createDataFrame([(u,) for u in own], "url string").select(F.explode(F.array_repeat("url", times)).alias("url"), F.lit(1).alias("rejected"))
        learnt = learnt.unionByName(sown)
    model = train(spark, learnt)
    limit = score(decided.where(kept_out).select("url"), model).agg(F.percentile_approx("ratio", 1 - false_alarms, 10000)).first()[0]
    limit = max(0.0, limit if limit is not None else 0.0)
    scored = score(judged.drop("id"), model)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("ratio") > limit, "block").otherwise("allow")).alias("verdict"), "ratio")
