"""Toxicity: a classifier that is regularised with counterfactual sentences.

It learns from at most SAMPLE labelled rows (a bound; the sample is the same at any run), equal texts
once. In three steps: words that mark either class far beyond chance (one of twenty corpora without any such
word would give one) are selected from counts made in Spark, as many as there are. What counts is in how many different surroundings (the words next to it) a word stands in either
class, so that the words of a text that was copied and labelled many times prove no more than once. A
logistic regression gives each a weight; a second one puts together their sum and how many of the
marking words a text has, so that one such word in a long text does not decide. Both are penalised
for changing a score when identity terms are swapped: in every text of the sample that has such a term, all its
places are given to each other term of its group, and to a neutral word that is in no table; the text goes through
both steps, and the squared differences of either step's score enter its loss. Both read which words a text has and
how often, so a swapped text is known by what it loses and gains. Identity terms never count as marking.

Scoring reads every text whole and looks its words up in the sorted table of selected words.

Cases: null and empty texts have no words and get the score of such; labels that are null, or of
unknown documents, are not used; several labels of a document count as the largest; repeated rows
are scored alike; without labels of both classes all scores are the share of toxic labels (0 without
labels); other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

SAMPLE = 20_000
#: Different surroundings in toxic texts that a word needs to be selected; and the weight from which it marks toxic texts.
PROOFS, MARKING = 3, 0.25
CUTOFF = 0.7
#: How much a squared change of score in a swapped sentence costs, against one misjudged text.
SWAP_WEIGHT = 5.0
LEVELS = 4
#: Rows of the sample that a step of the fit takes at once.
FIT_ROWS = 2048
#: Identity terms by group, in the languages of the corpus.
IDENTITY = (
    "men women boys girls males females transgender nonbinary",
    "gay lesbian bisexual queer straight homosexual heterosexual",
    "black white asian latino hispanic african european arab indigenous",
    "christian christians muslim muslims jewish jews hindu hindus buddhist buddhists atheist atheists catholic catholics",
    "immigrant immigrants refugee refugees foreigner foreigners citizen citizens",
    "old young elderly teenagers adults",
    "disabled deaf blind autistic",
    "frauen männer mädchen jungen schwule lesben juden muslime christen ausländer flüchtlinge",
    "femmes hommes filles garçons juifs musulmans chrétiens étrangers réfugiés immigrés",
    "mujeres hombres niñas niños judíos musulmanes cristianos extranjeros refugiados inmigrantes",
)


def groups() -> list[np.ndarray]:
    return [np.array([words.word_hash(w) for w in g.split()], np.uint64) for g in IDENTITY]


def in_fold(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows whose labels must not be learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, texts with it in either class) of these rows (text, toxic), a row for a word and a chunk."""
    shared.single_threaded()
    for rb in words.batches(rows, "text"):
        toxic = np.asarray(rb.column(1)).astype(np.int64)
        for first, h, offsets in words.texts_words(rb.column(0), words.ALNUM):
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            order = np.lexsort((text, h))
            h2, t2 = h[order], text[order]
            new = np.flatnonzero(np.concatenate([[True], (h2[1:] != h2[:-1]) | (t2[1:] != t2[:-1])])) if len(h2) else np.zeros(0, np.int64)
            w, y = h2[new], toxic[first + t2[new]]
            uniq, at = np.unique(w, return_index=True)
            n = np.diff(np.append(at, len(w)))
            bad = np.add.reduceat(y, at) if len(at) else n
            yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(n), pa.array(bad)], ["word", "n", "bad"])


def _surroundings(table: np.ndarray):
    """(word, hash of the words around it, toxic) wherever a word of the table stands."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        for rb in words.batches(rows, "text"):
            toxic = np.asarray(rb.column(1)).astype(np.int32)
            for first, h, offsets in words.texts_words(rb.column(0), words.ALNUM):
                before, after = np.zeros_like(h), np.zeros_like(h)
                before[1:], after[:-1] = h[:-1], h[1:]
                some = np.flatnonzero(np.diff(offsets))
                before[offsets[some]] = 0
                after[offsets[some + 1] - 1] = 0
                at = np.flatnonzero(_in(table, h))
                text = np.searchsorted(offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(words.pair(before[at], after[at]).view(np.int64)), pa.array(toxic[first + text])], ["word", "around", "toxic"])

    return run


def _features(table: np.ndarray, swaps: list[np.ndarray]):
    """Which selected words a text of (text, toxic) has, and how a swap in one of its sentences changes that."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        terms = np.unique(np.concatenate(swaps))
        for rb in words.batches(rows, "text"):
            found, counts, gone, come = [], [], [], []
            for _, h, offsets in words.texts_words(rb.column(0), words.ALNUM):
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    own = h[a:b]
                    uniq, n = np.unique(own[_in(table, own)], return_counts=True)
                    found.append(np.searchsorted(table, uniq).tolist())
                    counts.append(n.tolist())
                    # a swap takes one term away (by itself too, else terms would become equal, not harmless) or brings another in
                    have = np.unique(own[_in(terms, own)])
                    out, back = [], []
                    for term in have:
                        for group in swaps:
                            if term in group:
                                out.append(int(np.searchsorted(table, term)))
                                back.append(-1)
                                for other in group:
                                    if other != term:
                                        i, j = np.searchsorted(table, [term, other])
                                        i = int(i) if i < len(table) and table[i] == term else -1
                                        j = int(j) if j < len(table) and table[j] == other else -1
                                        if i >= 0 or j >= 0:
                                            out.append(i)
                                            back.append(j)
                    gone.append(out)
                    come.append(back)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([rb.column(1), *(pa.array(x, ints) for x in (found, counts, gone, come))], ["toxic", "words", "counts", "gone", "come"])

    return run


def _in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, changes: np.ndarray, ridge: float, steps: int = 60) -> np.ndarray:
    """Newton's method for a logistic regression (last weight: bias) whose loss also has SWAP_WEIGHT times
    the mean square of ``changes @ w``, the changes of the linear score under swaps."""
    size = x.shape[1] + 1
    keep = np.zeros((size, size))
    keep[np.arange(size - 1), np.arange(size - 1)] = ridge
    if len(changes):
        c1 = np.column_stack([changes, np.zeros(len(changes))])
        keep += 2 * SWAP_WEIGHT * len(x) / len(changes) * (c1.T @ c1)
    w = np.zeros(size)
    for _ in range(steps):
        slope, curve = keep @ w, keep + 1e-9 * np.eye(size)
        for a in range(0, len(x), FIT_ROWS):
            part = np.column_stack([x[a : a + FIT_ROWS], np.ones(len(x[a : a + FIT_ROWS]))]).astype(float)
            p = _sigmoid(part @ w)
            slope += part.T @ (p - y[a : a + FIT_ROWS])
            curve += (part * (p * (1 - p) + 1e-9)[:, None]).T @ part
        move = np.linalg.solve(curve, slope)
        w -= move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-7:
            break
    return w


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """labels: (doc_id, toxic). The model: sorted word hashes, their weights, which of them mark toxic texts, and the second step's weights."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.where(F.col("toxic").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers: small whatever the corpus
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = rows.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    held = shared.stored(spark, rows, "labelled")
    totals = held.groupBy("toxic").count().toPandas().set_index("toxic")["count"].to_dict()
    good, bad = int(totals.get(0, 0)), int(totals.get(1, 0))
    rate = bad / max(1, good + bad)
    empty = {"table": np.zeros(0, np.uint64), "weights": np.zeros(0), "marking": np.zeros(0, bool), "top": np.zeros(0), "rate": rate}
    if not good or not bad:
        return empty
    counts = held.mapInArrow(_count, "word long, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, b = F.col("n"), F.col("bad")
    term = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)
    gain = 2 * (term(b, n * rate) + term(n - b, n * (1 - rate)))  # log-likelihood ratio against chance
    least = 2 * math.log(max(counts.count(), 1) / 0.05)

    ids = lambda picked: np.unique(np.asarray(picked.toArrow()["word"], dtype=np.int64).view(np.uint64))
    likely = counts.withColumn("gain", gain).where(F.col("gain") >= least)
    around = held.mapInArrow(_surroundings(ids(likely.select("word"))), "word long, around long, toxic int")
    around = around.groupBy("word", "around").agg((F.avg("toxic") > 0.5).cast("long").alias("bad"))
    proven = around.groupBy("word").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).where(f"bad >= {PROOFS} AND 2 * bad >= n")
    chosen = ids(proven.select("word"))
    swaps = groups()
    table = np.unique(np.concatenate([chosen, *swaps]))
    seen = held.mapInArrow(_features(table, swaps), "toxic int, words array<int>, counts array<int>, gone array<int>, come array<int>").toArrow()
    y = np.asarray(seen["toxic"]).astype(float)
    flat = lambda name: np.concatenate([np.asarray(c.flatten()) for c in seen[name].chunks]).astype(np.int64) if seen.num_rows else np.zeros(0, np.int64)
    row = lambda name: np.repeat(np.arange(len(y)), np.asarray(pc.list_value_length(seen[name])).astype(np.int64))
    at, i, gone, come = flat("words"), row("gone"), flat("gone"), flat("come")
    # only words that occur get a column; at most `sample` rows, a byte for each
    used = np.unique(np.concatenate([at, gone[gone >= 0], come[come >= 0]]))
    if not len(used):
        return empty
    who, at = row("words"), np.searchsorted(used, at)
    x = np.zeros((len(y), len(used)), np.uint8)
    x[who, at] = 1
    gone, come = np.searchsorted(used, gone), np.where(come >= 0, np.searchsorted(used, come), -1)
    kinds = np.unique(np.column_stack([gone, come]), axis=0)  # a row for a pair of terms, however many texts have it
    delta = np.zeros((len(kinds), len(used)), np.float32)
    delta[np.arange(len(kinds)), kinds[:, 0]] = -1
    delta[np.flatnonzero(kinds[:, 1] >= 0), kinds[kinds[:, 1] >= 0, 1]] = 1
    w = fit(x, y, delta, 1.0)[:-1]
    # what a text says of a group is no mark, so that a swap leaves its hits as they are
    marking = (w > MARKING) & ~_in(np.unique(np.concatenate(swaps)), table[used])
    hits = np.bincount(who, weights=flat("counts") * marking[at], minlength=len(y))
    linear = np.bincount(who, weights=w[at], minlength=len(y))
    levels = _levels(linear, hits)
    after = linear[i] - w[gone] + np.where((come >= 0) & (x[i, come] == 0), w[come], 0)
    top = fit(levels, y, _levels(after, hits[i]) - levels[i], 0.3)
    order = np.argsort(used)
    return {"table": table[used[order]], "weights": w[order], "marking": marking[order], "top": top, "rate": rate}


def _levels(linear: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Features of the second step: has the text one marking word, two, ...; and the first step's sum, from two on."""
    at_least = [(hits >= k).astype(float) for k in range(1, LEVELS + 1)]
    return np.column_stack([np.clip(linear, -3, 3) / 3 * (hits >= 2), *at_least])


def scores(model: dict, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if not len(model["top"]):
        return np.full(n, model["rate"])
    text = np.repeat(np.arange(n), np.diff(offsets))
    hit = _in(model["table"], h)
    at, who = np.searchsorted(model["table"], h[hit]), text[hit]
    hits = np.bincount(who, weights=model["marking"][at].astype(float), minlength=n)
    once = np.unique(who * np.int64(len(model["table"])) + at)
    linear = np.bincount(once // len(model["table"]), weights=model["weights"][once % len(model["table"])], minlength=n)
    x = _levels(linear, hits)
    return _sigmoid(np.column_stack([x, np.ones(n)]) @ model["top"])


def _score(model, own: int):
    """Columns (text, others ...) with a score; own: how many other columns there are."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.single_threaded()
        for rb in rows:
            for small in words.batches([rb], rb.schema.names[0]):
                out = [scores(model.value, h, offsets) for _, h, offsets in words.texts_words(small.column(0), words.ALNUM)]
                yield pa.RecordBatch.from_arrays([*small.columns[1:], pa.array(np.concatenate(out) if out else np.zeros(0))], [f"c{i}" for i in range(own + 1)])

    return run


def score(spark: SparkSession, docs: DataFrame, keep: list[str], model: dict) -> tuple[DataFrame, str]:
    """The columns to keep of every row of docs, and a score from 0 to 1 of its text; and the score's name."""
    (name,) = shared.fresh(keep, "score")
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *(shared.quoted(k).alias(f"c{i}") for i, k in enumerate(keep)))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model), len(keep)), shared.with_fields(docs, keep, (name, "double"))), name


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; learns from labels outside the fold."""
    model = train(spark, docs, labels.where(~in_fold(F.col("doc_id"))))
    scored, name = score(spark, docs, ["doc_id"], model)
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), name, (F.col(name) >= CUTOFF).cast("int").alias("predicted"))


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those judged toxic, all columns as they were, whatever their names."""
    model = train(spark, docs, labels.where(~in_fold(F.col("doc_id"))))
    scored, name = score(spark, docs, docs.columns, model)
    return scored.where(F.col(name) < CUTOFF).select(*map(shared.quoted, docs.columns))
