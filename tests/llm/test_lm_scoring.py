import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwell.llm import lm_scoring

SCHEMA = "doc_id long, text string, score string"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(docs, order):
    """The same model with dictionaries."""
    counts, raw = [Counter() for _ in range(order + 1)], Counter()
    for i, text in docs:
        if zlib.crc32(str(i if i is not None else "").encode()) % 10:
            before = ("<s>",) * (order - 1)
            for t in tokens(text):
                counts[order][*before, t] += 1
                raw[t] += 1
                before = (*before, t)[1:]
    n, v = sum(raw.values()), len(raw)
    for k in range(order - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1
    total, kinds = Counter(), defaultdict(Counter)
    for k in range(2, order + 1):
        for gram, c in counts[k].items():
            total[gram[:-1]] += c
            kinds[gram[:-1]][min(c, 3)] += 1
    d = [None, *((0, *lm_scoring.discounts(*(sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)))) for k in range(1, order + 1))]

    def p(*gram):
        k = len(gram)
        c = counts[k][gram]
        if k == 1:
            if not raw:
                return 1 / (v + 1)
            rest = sum(d[1][min(c, 3)] for c in counts[1].values())
            return (max(c - d[1][min(c, 3)], 0) + rest / (v + 1)) / sum(counts[1].values())
        context = gram[:-1]
        if not total[context]:
            return p(*gram[1:])
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][i] * x for i, x in kinds[context].items()) * p(*gram[1:])) / total[context]

    p = functools.cache(p)
    out = []
    for i, text in docs:
        toks, before, score = tokens(text), ("<s>",) * (order - 1), 0.0
        for t in toks:
            score += math.log10(p(*before, t))
            before = (*before, t)[1:]
        out.append((i, len(toks), sum(raw[t] > 0 for t in toks), n, sum(math.log10((raw[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks), score))
    return out, p, raw


def corpus(n, seed=1):
    r = random.Random(seed)
    names = [f"w{int(r.paretovariate(0.9))}" for _ in range(400)]
    return [(i, " ".join(r.choice(names) for _ in range(r.randint(0, 60)))) for i in range(n)]


def check(spark, docs, order):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    got = sorted((tuple(r[k] for k in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in lm_scoring.lm_scores(spark, df, order).collect()), key=str)
    want = sorted(brute(docs, order)[0], key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_against_dictionaries(spark, order):
    docs = corpus(300)
    check(spark, [*docs, (300, None), (301, ""), (302, "É x Été ÉTÉ\x0b\ta"), (7, docs[7][1]), (None, "w1 w2"), (303, "long " * 50_000), (304, "x" * 300_000)], order)


@pytest.mark.parametrize("order", [2, 3])
def test_many_shards(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", {order: 40})
    monkeypatch.setattr(lm_scoring, "FLUSH", 500)
    check(spark, corpus(200, 2), order)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_add_up(order):
    docs = corpus(100, 3)
    _, p, raw = brute(docs, order)
    for before in ("w1 w2", "w2 w1", "<s> w1", "<s> <s>", "never seen"):
        assert sum(p(*before.split()[-order + 1 :], t) for t in [*raw, "unknown"]) == pytest.approx(1)


def test_counts_beyond_32_bits():
    few, many = np.array([1, 255], np.uint64), np.array([1, 1 << 40], np.uint64)
    assert lm_scoring._narrow(few).dtype == np.uint8 and lm_scoring._narrow(many).dtype == np.uint64
    keys, _, (sums,) = lm_scoring._merge(np.zeros(3, np.uint64), np.full(3, 0xFFFFFFFF, np.uint32))
    assert keys.tolist() == [0] and sums.tolist() == [3 * 0xFFFFFFFF]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lm_scoring.lm_scores(spark, df).collect() == []


@pytest.mark.parametrize("order", [2, 3])
def test_only_held_out(spark, order):
    check(spark, [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0], order)
