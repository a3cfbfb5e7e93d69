import random
import zlib

import numpy as np

from siftwell.llm import toxicity, words

SCHEMA = "doc_id long, text string, score string"
BAD = ["grub", "snark", "vile", "oaf"]


def example(n=900, seed=1, group=False):
    """Toxic texts have two or more bad words; clean ones may have one. With group, toxic ones often name a group."""
    r = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [r.choice(plain) for _ in range(r.randint(8, 60))]
        for _ in range(r.randint(2, 4) if toxic else int(r.random() < 0.1)):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        if group and (toxic and r.random() < 0.7 or r.random() < 0.05):
            w.insert(r.randrange(len(w)), "muslims")
        docs.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame([(*x, "z") for x in docs], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    return toxicity.toxicity(spark, d, lab).collect()


def test_held_out_accuracy(spark):
    docs, labels = example()
    copy = (5000, docs[0][1])
    odd = [(6000, None), (6001, ""), (6002, "w1 " * 100_000), (None, "grub and oaf"), (3, docs[3][1])]
    rows = run(spark, [*docs, copy, *odd], [*labels, (3, None), (None, 1), (99999, 1), (7, 1)])
    assert len(rows) == len(docs) + 6
    held = {r["doc_id"]: r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900}
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held)
    wrong = sum(r["predicted"] != dict(labels)[i] for i, r in held.items())
    assert wrong <= 0.03 * len(held)
    by = {r["doc_id"]: r for r in rows}
    assert by[5000]["score"] == by[0]["score"] and by[6000]["score"] == by[6001]["score"] and by[6002]["predicted"] == 0 and by[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_neutral_mentions_of_a_group(spark, monkeypatch):
    docs, labels = example(group=True)
    neutral = [(10_000 + i, f"w{i} muslims w{i + 1} muslims w{i + 2} w{i + 3}") for i in range(40)]
    rows = {r["doc_id"]: r for r in run(spark, [*docs, *neutral], labels)}
    assert sum(rows[i]["predicted"] for i, _ in neutral) == 0
    # the penalty is what keeps the group's name from counting
    x = np.zeros((200, 2), np.float32)
    y = np.arange(200) % 2.0
    x[:, 0] = y
    x[:, 1] = y
    free = toxicity.fit(x, y, np.zeros((0, 2)), 1.0)
    held = toxicity.fit(x, y, np.array([[0.0, 1.0]]), 1.0)
    assert abs(held[1]) < 0.1 * abs(free[1]) and held[0] > free[0]


def test_copies_prove_nothing(spark):
    docs, labels = example(400)
    names = " ".join(f"copied{k}" for k in range(40))
    docs += [(1000 + i, f"{names} w{i}") for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    other = [(2000, " ".join(f"copied{k} w{k}" for k in range(0, 40, 8)))]
    rows = {r["doc_id"]: r for r in run(spark, [*docs, *other], labels)}
    assert rows[2000]["predicted"] == 0


def test_nothing_to_learn_from(spark):
    docs, labels = example(40)
    assert {r["score"] for r in run(spark, docs, [])} == {0.0}
    assert {r["predicted"] for r in run(spark, docs, [(i, 0) for i, _ in labels])} == {0}
    assert run(spark, [], labels) == []


def test_clean_keeps_columns(spark):
    docs, labels = example()
    d = spark.createDataFrame([(*x, "z") for x in docs], SCHEMA)
    kept = toxicity.clean(spark, d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == ["doc_id", "text", "score"]
    rows = kept.collect()
    assert set(map(tuple, rows)) <= {(*x, "z") for x in docs}
    assert abs(len(rows) - 675) < 30


def test_levels_look_words_up():
    table = np.sort(np.array([words.word_hash(w) for w in ("a", "b")], np.uint64))
    model = {"table": table, "weights": np.ones(2), "marking": np.ones(2, bool), "top": np.array([0, 1.0, 0, 0, 0, -1.0]), "rate": 0.5}
    h = np.array([words.word_hash(w) for w in ("a", "x", "x")], np.uint64)
    assert np.allclose(toxicity.scores(model, h, np.array([0, 1, 3, 3])), 1 / (1 + np.exp([0, 1, 1])))


def test_groups_do_not_stand_in_for_missing_insults(spark):
    """A third of the toxic texts has no insult and 70 % name a group: naming it is still no offence, whatever else a text has."""
    docs, labels = example(3000, group=True)
    r = random.Random(3)
    docs = [(i, " ".join(w for w in t.lower().rstrip(".").split() if w not in BAD) if i % 12 == 0 else t) for i, t in docs]
    plain = [" ".join(r.choice([f"w{i}" for i in range(300)]) for _ in range(20)) for _ in range(40)]
    ends = {"none": "", "group": " muslims", "twice": " muslims so muslims", "partner": " atheists so atheists", "two": " grub snark", "two and group": " grub muslims snark"}
    extra = [(10_000 + 100 * k + i, t + end) for k, end in enumerate(ends.values()) for i, t in enumerate(plain)]
    rows = {x["doc_id"]: x for x in run(spark, [*docs, *extra], labels)}
    scores = {name: np.array([rows[10_000 + 100 * k + i]["score"] for i in range(len(plain))]) for k, name in enumerate(ends)}
    for name in ("group", "twice", "partner"):
        assert np.abs(scores[name] - scores["none"]).max() < 0.05 and scores[name].max() < 0.5
    assert np.abs(scores["two and group"] - scores["two"]).max() < 0.05 and scores["two"].min() > 0.7


def test_more_marking_words_than_any_fixed_number(spark):
    """Every toxic text has its own mix of 900 insults, each of them proven: all get a weight for it."""
    r = random.Random(8)
    insults, plain = [f"bad{i}" for i in range(900)], [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(4000):
        w = [r.choice(plain) for _ in range(20)]
        for _ in range(20 * (i % 2)):
            w.insert(r.randrange(len(w)), r.choice(insults))
        docs.append((i, " ".join(w)))
        labels.append((i, i % 2))
    d = spark.createDataFrame([(*x, "z") for x in docs], SCHEMA)
    model = toxicity.train(spark, d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    have = set(model["table"][model["weights"] > 0].tolist())
    assert sum(words.word_hash(w) in have for w in insults) >= 890


def test_clean_with_odd_columns(spark):
    docs, labels = example(200)
    d = spark.createDataFrame([(*x, "z", "a", "b") for x in docs], "doc_id long, text string, score string, `a.b` string, `_text` string")
    kept = toxicity.clean(spark, d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == d.columns and set(map(tuple, kept.collect())) <= {(*x, "z", "a", "b") for x in docs}
