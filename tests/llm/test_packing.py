import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftwell.llm import packing

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_quick_coder_has_the_same_ids():
    whole = Tokenizer.from_file(VOCABULARY)
    r = random.Random(1)
    texts = ["", " ", "Hello  world\n\n", "é ß 漢字 🙂", "a<|endoftext|>b", "x" * 3000, "\x00\x01 \t\r\n", "don't I'LL we've 12345 ___ !!"]
    texts += ["".join(r.choice("abc é\n \t'1漢<|>") for _ in range(r.randint(0, 400))) for _ in range(300)]
    assert packing.coder(VOCABULARY, RANKS)(texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def best(lengths, capacity):
    """The least number of bins, by trying all (small cases)."""
    lengths = sorted(lengths, reverse=True)
    most = [len(lengths)]

    def place(i, bins):
        if len(bins) >= most[0]:
            return
        if i == len(lengths):
            most[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= lengths[i]:
                rest = list(bins)
                rest.remove(room)
                place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return most[0]


def test_bounds_are_bounds():
    r = random.Random(2)
    for _ in range(150):
        c = r.choice([10, 16, 30])
        lengths = np.array([r.randint(1, c) for _ in range(r.randint(1, 8))])
        bins, offsets, fills = packing.best_fit(lengths, c)
        assert packing.lower_bound(lengths, c) <= best(lengths.tolist(), c) <= len(fills)
        assert fills.max() <= c and fills.sum() == lengths.sum()
        for b in range(len(fills)):
            own = np.flatnonzero(bins == b)
            spans = sorted(zip(offsets[own], lengths[own], strict=True))
            assert [s[0] for s in spans] == [0, *np.cumsum([s[1] for s in spans])[:-1]]


def check(spark, docs, capacity=64, **more):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int")
    cut = packing.shared.stored(spark, packing.pieces(df, VOCABULARY, RANKS, capacity), "pieces")
    rows = packing.pack(spark, cut, capacity, **more).collect()
    whole = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [s[0] for s in spans] == [0, *np.cumsum([s[1] for s in spans])[:-1]]
        assert sum(s[1] for s in spans) <= capacity
    return len(by), packing.lower_bound(np.array([r["length"] for r in rows], np.int64), capacity) if rows else 0


def test_packs_all_pieces(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["a", "word", "longer", "é"]) for _ in range(r.randint(0, 120)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "x y " * 2000), (5, docs[5][1]), (None, "no id")]
    used, least = check(spark, docs)
    assert used <= least + 1


def test_partitions_exchange(spark):
    r = random.Random(4)
    docs = [(i, "a " * r.randint(0, 63)) for i in range(400)]
    used, least = check(spark, docs, part_rows=40)
    alone, _ = check(spark, docs, part_rows=40, rounds=1)
    whole, _ = check(spark, docs)
    assert least <= whole <= used <= whole * 1.08 and used <= alone


def test_empty_table(spark):
    assert check(spark, []) == (0, 0)


@pytest.mark.parametrize("capacity", [1, 2])
def test_tiny_sequences(spark, capacity):
    check(spark, [(1, "a b c"), (2, "")], capacity)
