import hashlib
import random
import re

from siftwell.llm import decontaminate


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    """Every window looked for at every place."""
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for item, t in items:
            b = words(t)
            n = min(8, len(b))
            if item is None or not n:
                continue
            wanted = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in wanted:
                    hit[at : at + n] = [True] * n
                    found.add(str(item))
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def example(seed=5):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    items = [(i, some(r.choice([0, 1, 3, 7, 8, 9, 20]))) for i in range(12)] + [(3, some(30)), (None, some(9)), (40, None), (41, ""), (42, "É Zß, É zß x1 x2 x3 x4 x5")]
    docs = [(i, some(r.randint(0, 300))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "... !"), (103, "é é É zß é ZSS " + items[-1][1]), (104, items[12][1].upper() + ". " + items[2][1]), (104, "x"), (None, "a b c d e f g h"), (105, "q " * 60_000 + str(items[12][1]))]
    return docs, items


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")
    return sorted((tuple(r) for r in decontaminate.report(spark, d, b, **more).collect()), key=str)


def test_against_all_windows(spark):
    docs, items = example()
    assert run(spark, docs, items) == brute(docs, items)


def test_random_texts(spark):
    for seed in range(3):
        r = random.Random(seed)
        some = lambda n, r=r: " ".join(r.choice("abc") for _ in range(n))
        docs, items = [(i, some(r.randint(0, 80))) for i in range(30)], [(i, some(r.randint(1, 14))) for i in range(6)]
        assert run(spark, docs, items) == brute(docs, items)


def test_in_blocks(spark):
    docs, items = example(6)
    assert run(spark, docs, items, limit=40) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def shares(text, items):
    """Whether a text has a whole window of an item."""
    long = [x for x in items if len(words(x[1])) >= 8]
    return brute([(0, text)], long)[0][3] > 0


def test_clean_keeps_the_rest_as_it_was(spark):
    docs, items = example()
    columns = "doc_id long, text string, items string, n_words string, `a.b` string, `_text` string"
    d = spark.createDataFrame([(i, t, "x", "y", "z", "u") for i, t in docs], columns)
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.clean(spark, d, b)
    assert kept.columns == d.columns
    want = [(i, t, "x", "y", "z", "u") for i, t in docs if not shares(t, items)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    assert 0 < len(want) < len(docs)


def test_one_passage_condemns(spark):
    passage = "one two three four five six seven eight nine ten"
    items = [(1, passage), (2, "short item of six words only"), (3, "eleven twelve")]
    docs = [(1, f"before {passage.upper()}, after"), (2, "one two three four five six seven 8 nine ten"), (3, "a short item of six words only here eleven twelve"), (4, "two three four five six seven eight nine")]
    kept = decontaminate.clean(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
