import zlib

import numpy as np
from pyspark.sql import functions as F

from lumenveil.llm import quality as Q
from lumenveil.llm.queries import op10_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op10_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_passages_are_the_whole_text():
    for text in ("", "a", "ab " * 5000, "x" * 10000, "word\n\n" * 900):
        assert "".join("".join(Q.passages(text)).split()) == "".join(text.split())
        assert max(map(len, Q.passages(text))) <= 4 * Q.PASSAGE


def test_letters_are_counted_over_the_whole_passage():
    good = "a" * 400
    at = next(i for i, (a, b) in enumerate(zip(Q.measures(good + "a" * 400, 1, 0.0), Q.measures("\u3001" * 800, 1, 0.0))) if (a, b) == (1.0, 0.0))
    assert Q.measures(good + "\u3001" * 400, 1, 0.0)[at] == 0.5


def test_gradients():
    r = np.random.default_rng(0)
    net = Q.Net(3)
    for k in Q.Net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    net.mean, net.std = net.mean.astype(np.float64), net.std.astype(np.float64)
    x, start, y = r.standard_normal((9, Q.N_MEASURES)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-(y * np.log(net.forward(x, start)[0]) + (1 - y) * np.log(1 - net.forward(x, start)[0])).sum())
    p, kept = net.forward(x, start)
    for k, g in net.back(p - y, kept, start).items():
        w = getattr(net, k)
        i = tuple(r.integers(0, s) for s in w.shape)
        w[i] += 1e-6
        up = loss()
        w[i] -= 2e-6
        down = loss()
        w[i] += 1e-6
        assert abs((up - down) / 2e-6 - g[i]) < 1e-4, k


def test_scores_equal_a_forward_pass_by_hand(spark):
    """Every number computed by plain loops from the model's weights."""
    import math
    import pickle

    texts = [None, "", "one two three. " * 300, "!!! $$$ ### " * 200, "Ein Satz.\nEin Satz.\nNoch einer", "x" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = Q.fit(df, spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id bigint, quality int"))
    net = pickle.loads(model)
    for r in Q.score(df, model).collect():
        hidden, weight = [], []
        for row in Q.encode(r["text"]):
            x = [min(8.0, max(-8.0, (float(v) - float(m)) / float(s))) for v, m, s in zip(row, net.mean, net.std)]
            h = [math.tanh(sum(a * float(net.We[i, j]) for i, a in enumerate(x)) + float(net.be[j])) for j in range(Q.HIDDEN)]
            t = [math.tanh(sum(h[i] * float(net.V[i, j]) for i in range(Q.HIDDEN))) for j in range(Q.GATE)]
            g = [1 / (1 + math.exp(-sum(h[i] * float(net.U[i, j]) for i in range(Q.HIDDEN)))) for j in range(Q.GATE)]
            hidden.append(h)
            weight.append(math.exp(sum(a * b * float(w) for a, b, w in zip(t, g, net.wa))))
        z = [sum(w * h[j] for w, h in zip(weight, hidden)) / sum(weight) for j in range(Q.HIDDEN)]
        p = 1 / (1 + math.exp(-(sum(a * float(w) for a, w in zip(z, net.wc)) + float(net.bc[0]))))
        assert abs(p - r["score"]) < 1e-4


def test_every_word_counts():
    a, b = Q.lexical("alpha beta gamma"), Q.lexical("alpha beta delta")
    assert abs(float((a * a).sum()) - 1) < 1e-6 and not np.array_equal(a, b)
    long = "word " * 5000
    assert not np.array_equal(Q.encode(long), Q.encode(long + "other")) and len(Q.condensed(Q.encode(long))) <= Q.TRAIN_PASSAGES
    bag = np.arange(400, dtype=np.float32).reshape(100, 4)
    assert np.allclose(Q.condensed(bag, 10), bag.reshape(10, 10, 4).mean(1))


def test_repeated_labelled_ids_are_learned_from_once(spark):
    df = spark.createDataFrame([(i % 4, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i % 4, i % 2) for i in range(12)], "doc_id bigint, quality int")
    from lumenveil.llm._common import labelled_features

    got = labelled_features(df, labels.withColumnRenamed("quality", "label"), lambda t: t.encode()).collect()
    assert len(got) == 4


def test_one_bad_passage_gets_the_attention():
    good = np.zeros((6, Q.N_MEASURES), np.float32)
    bad = good.copy()
    bad[3, 0] = 1
    r = np.random.default_rng(1)
    noise = lambda a: a + 0.05 * r.standard_normal(a.shape).astype(np.float32)
    bags = [noise(bad if i % 2 else good) for i in range(400)]
    net = Q.train(bags, np.array([1.0 - i % 2 for i in range(400)], np.float32))
    p, kept = net.forward(np.concatenate([good, bad]), np.array([0, 6]))
    assert p[0] > 0.5 > p[1]


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 60000), (3, "x"), (4, "\n\n")], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    none = Q.fit(df, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r["score"] for r in Q.score(df, none).collect()} == {0.5}
    some = Q.fit(df, spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id bigint, quality int"))
    assert Q.score(df, some).count() == 5 and Q.score(df.limit(0), some).count() == 0
