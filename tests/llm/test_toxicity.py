import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from lumenveil.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) > 0
    scored = T.score(docs, T.fit(docs, labels.filter(even))).join(labels.filter(~even).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    c = {(r["label"], r["toxic"]): r["count"] for r in scored.groupBy("label", "toxic").count().collect()}
    # The label has toxic documents without any telling word; clean ones must be left alone.
    assert c.get((0, True), 0) <= 0.01 * c[(0, False)]
    assert c[(1, True)] >= 0.6 * (c[(1, True)] + c.get((1, False), 0))


def sketches(texts):
    return [T.shingles(t) for t in texts]


def made(n, seed):
    r = random.Random(seed)
    vocabulary = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        text = [r.choice(vocabulary) for _ in range(80)]
        if toxic:
            text[r.randrange(80)] = r.choice(["idiot", "moron"])
            text[r.randrange(80)] = r.choice(["trash", "blurgheit", "blurghung"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_chain_and_defined_cases(spark):
    rows = made(600, 1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = T.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    new = made(60, 2) + [(900, None, 0), (901, "", 0), (902, "123 !!", 0), (903, "clean " * 30000, 0), (903, "clean " * 30000, 0)]
    given = spark.createDataFrame(new, "doc_id bigint, text string, label int").withColumn("p_toxic", F.lit("clash"))
    got = T.score(given, model).collect()
    assert len(got) == len(new)
    assert all(r["toxic"] == bool(r["label"]) for r in got if r["text"])
    assert all(0 <= r[f"p_{c}"] <= 1 for r in got for c in T.CATEGORIES)
    index, chain, constant = pickle.loads(model)
    assert constant is None and [len(w) for w in chain] == [len(index) + 1 + i for i in range(3)]
    assert T.score(given.limit(0), model).count() == 0


def test_one_class_or_no_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    for labels, want in (([], False), ([(1, 0)], False), ([(1, 1), (2, 1)], True), ([(1, None)], False)):
        table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
        assert {r["toxic"] for r in T.score(df, T.fit(df, table)).collect()} == {want}


def test_copies_count_once():
    r = random.Random(3)
    texts = [[f"{i}w{r.randrange(10**6)}" for _ in range(60)] for i in range(5)]
    near = [[*texts[0][:57], "x"] for _ in range(50)]
    few = [[r.choice("abcdefghij") for _ in range(60)] for _ in range(20)]  # no copies, only few words
    assert T._distinct(sketches(texts + near)) == [0, 1, 2, 3, 4]
    assert len(T._distinct(sketches(few))) == 20 and T._distinct(sketches([[], ["a"], ["a"]])) == [1]


def test_only_copies_of_one_label_are_dropped():
    r = random.Random(4)
    line = [f"common{i}" for i in range(40)]
    sharing = [line + [f"{i}w{r.randrange(10**6)}" for _ in range(60)] for i in range(200)]  # similarity 0.2 to 0.3
    assert T._distinct(sketches(sharing)) == list(range(200))
    clean = [f"w{i}" for i in range(60)]
    assert T._distinct(sketches([clean, [*clean, "idiot"], clean]), [False, True, False]) == [0, 1]
    # Against all pairs, on texts of every similarity.
    base = [f"b{i}" for i in range(80)]
    texts = [base[: r.randrange(40, 80)] + [f"{i}x{j}" for j in range(r.randrange(20))] for i in range(80)]
    sets = [{" ".join(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
    want: list[int] = []
    for i, s in enumerate(sets):
        if all(len(s & sets[k]) < 0.8 * len(s | sets[k]) for k in want):
            want.append(i)
    assert T._distinct(sketches(texts)) == want and 1 < len(want) < 80


def test_out_of_fold_inputs():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (400, 3)).astype(np.float32)
    y = np.stack([x[:, 0], x[:, 0] * x[:, 1], x[:, 0]], 1) > 0
    chain = T.fit_chain(x, y, np.arange(400) % T.FOLDS)
    p = x
    for w in chain:
        p = np.hstack([p, T._probability(w, p)[:, None].astype(np.float32)])
    assert ((p[:, -1] > 0.5) == y[:, 2]).mean() > 0.99


def test_categories_come_from_features_that_occur_together():
    r = np.random.default_rng(4)
    x = np.zeros((200, 8), np.float32)
    for row in x:
        first = r.random() < 0.5
        row[(r.permutation(5)[:3] if first else 5 + r.permutation(3)[:2])] = 1
    of = T.grouped(x)
    assert len(set(of[:5])) == len(set(of[5:])) == 1 and of[0] != of[5]


def test_model_and_scores_by_plain_loops(spark):
    """Evidence counted anew, chain applied by hand to texts that the model never saw."""
    import math

    rows = made(400, 5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = T.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    chosen, chain, _ = pickle.loads(model)
    count = {}
    for _, text, toxic in rows:
        for b in {b for w in set(text.split()) for b in T.buckets(w)}:
            count.setdefault(b, [0, 0])[toxic] += 1
    n = [sum(1 - t for *_, t in rows), sum(t for *_, t in rows)]
    want = []
    for b, (neg, pos) in count.items():
        rate = n[1] / sum(n)
        g = 2 * sum(o * math.log(o / e) for o, e in ((pos, (pos + neg) * rate), (neg, (pos + neg) * (1 - rate))) if o)
        if pos >= 3 and pos / (pos + neg) > rate and g >= T.EVIDENCE:
            want.append(b)
    assert sorted(chosen.tolist()) == sorted(want) and 0 < len(want) <= T.FEATURES
    for r in T.score(spark.createDataFrame([row[:2] for row in made(40, 6)], "doc_id bigint, text string"), model).collect():
        x = [float(any(b in T.buckets(w) for w in r["text"].split())) for b in chosen.tolist()]
        for w, c in zip(chain, T.CATEGORIES):
            p = 1 / (1 + math.exp(-(sum(a * float(v) for a, v in zip(x, w)) + float(w[-1]))))
            assert abs(p - r[f"p_{c}"]) < 1e-3
            x.append(p)


def test_very_long_texts_are_scored_but_bound_in_the_sample():
    long = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}zz" for i in range(17000))
    assert T.encode(long) == np.zeros(1, "<u4").tobytes() and len(T.encode("some words " * 90000)) < 4 * (T.SKETCH + T.WIDE)
