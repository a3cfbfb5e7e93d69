import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from siftwell.llm import near_dups

SCHEMA = "doc_id long, text string, node string"


def bag(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs):
    """Connected components over all pairs."""
    bags = [bag(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    parts = {}
    for i in range(len(docs)):
        parts.setdefault(find(i), []).append(i)
    out = {}
    for own in parts.values():
        ids = [docs[i][0] for i in own if docs[i][0] is not None]
        for i in own:
            out.setdefault(docs[i], []).append((min(ids) if ids else None, len(own)))
    return out


def example(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = lambda n: [r.choice(words) for _ in range(n)]
    docs, passage = [], base(60)
    for i in range(60):
        docs.append((i, " ".join(base(r.randint(5, 150)) + (passage if i % 3 == 0 else []))))
    for i in range(60, 200):
        text = docs[r.randrange(60)][1].split()
        for _ in range(r.randint(0, 6)):
            text[r.randrange(len(text))] = r.choice(words)
        docs.append((i, " ".join(text)))
    hot = base(120)
    for i in range(200, 300):
        text = list(hot)
        for k in r.sample(range(120), r.randint(0, 4)):
            text[k] = r.choice(words)
        docs.append((i, " ".join(text)))
    docs += [(300, None), (301, ""), (302, "  !"), (303, "Short one"), (304, "short, ONE."), (305, "same " * 400), (306, "same " * 380), (307, "same " * 200), (5, docs[5][1]), (None, docs[7][1]), (None, "all alone and without an id here"), (308, "long " + " ".join(base(30_000)))]
    return docs


@pytest.mark.parametrize("block, mass, hot", [(16, 1 << 22, 256), (1024, 2000, 2)])
def test_against_all_pairs(spark, monkeypatch, block, mass, hot):
    monkeypatch.setattr(near_dups, "SMALL", 4)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "MASS", mass)
    monkeypatch.setattr(near_dups, "HOT", hot)
    docs = example()
    df = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).repartition(4)
    texts = Counter(docs)
    want = Counter()
    for (i, t), found in brute(docs).items():
        for name, n in found:
            want[i, name, n] += 1
    assert sum(texts.values()) == sum(want.values())
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dups.near_duplicates(spark, df).collect()) == want


@pytest.mark.parametrize("repeated", [False, True])
def test_one_of_each_class_stays(spark, repeated):
    docs = [d for d in example(2) if d[0] is not None]
    if not repeated:
        docs = list(dict(docs).items())
    df = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA)
    kept = near_dups.clean(spark, df)
    assert kept.columns == ["doc_id", "text", "node"]
    want = {(name, i if not bag(t) else None) for (i, t), found in brute(docs).items() for name, _ in found}
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(name for name, _ in want)
    assert all((r["doc_id"], r["text"]) in set(docs) for r in rows)


@pytest.mark.parametrize("repeated", [False, True])
def test_columns_of_any_name_stay(spark, repeated):
    names = ["doc_id", "text", "node", "least", "_gone", "_node", "row", "stays", "class_id", "a.b", "c`d"]
    texts = ["one two three four five six", "One, two three four five six!", None, "seven"]
    rows = [(i % 3 if repeated else i, t, *(f"{n}{i}" for n in names[2:])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in names]))
    kept = near_dups.clean(spark, df)
    assert kept.columns == names
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((rows[i] for i in (0, 2, 3)), key=str)


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(3)
    element = r.integers(0, 1 << 62, 80).astype(np.uint64)
    wa, wb = r.integers(1, 9, 60), r.integers(1, 9, 60)
    text = np.concatenate([np.zeros(60, int), np.ones(60, int)])
    el, w = np.concatenate([element[:60], element[20:]]), np.concatenate([wa, wb])
    both = np.minimum(wa[20:], wb[:40]).sum()
    wanted = both / (w.sum() - both)
    found = near_dups.dart_minhash(text, el, w, 2, 4096)
    assert abs((found[0] == found[1]).mean() - wanted) < 0.03
    assert (near_dups.dart_minhash(text[:60], el[:60], w[:60], 1, 4096) == found[0]).all()
    assert (near_dups.dart_minhash(np.zeros(1, int), element[:1], np.ones(1, int), 1, 64) != 0).all()


def test_sketches_agree_as_signatures_do():
    r = np.random.default_rng(4)
    a = r.integers(1, 1 << 62, 512).astype(np.uint64)
    b = np.where(r.random(512) < 0.8, a, a + np.uint64(1))
    x, y = near_dups.sketch(np.stack([a, b]))
    same = ((x >> 4) == (y >> 4)).sum() + ((x & 15) == (y & 15)).sum()
    assert abs(same / 512 - ((a == b).mean() * 15 / 16 + 1 / 16)) < 0.06


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_dups.near_duplicates(spark, df).collect() == [] and near_dups.clean(spark, df).collect() == []


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(30)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {n: find(n) for e in edges for n in e if e[0] != e[1]}
    assert {r[0]: r[1] for r in near_dups.components(spark, df).collect()} == want
