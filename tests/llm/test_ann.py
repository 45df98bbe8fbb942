import numpy as np

from lumenveil.llm import ann as A


def brute(vecs, q, k):
    out = {}
    for i in q:
        if i not in vecs:
            continue
        d = sorted((float(np.sqrt(((vecs[j] - vecs[i]) ** 2).sum())), j) for j in vecs if j != i)
        out[i] = d[:k]
    return out


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = A.nearest(df, df.filter("vec_id % 100 = 0")).collect()
    vecs = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect()}
    want = brute(vecs, [i for i in vecs if i % 100 == 0], 10)
    assert len(got) == 10 * len(want)
    hits = sum((r["vec_id"] in {j for _, j in want[r["query_id"]]}) for r in got)
    assert hits >= 0.95 * len(got)
    for r in got:
        assert abs(r["score"] - np.sqrt(((vecs[r["vec_id"]] - vecs[r["query_id"]]) ** 2).sum())) < 1e-12


def test_odd_vectors_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "QUERY_BLOCK", 2)
    monkeypatch.setattr(A, "SHARD", 4)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (200, [1.0, 1.0]), (300, [2.0, 0.5])] + [(i, [1.0, 0.0]) for i in range(1, 8)]
    rows += [(400, None), (500, [0.0, 0.0]), (600, [nan, 1.0]), (700, [inf, 1.0]), (800, [None, 1.0]), (900, []), (901, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in sorted(A.nearest(df, df.filter("vec_id % 100 = 0"), 5).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    vecs = {i: np.array(v, np.float64) for i, v in rows[:11]}
    want = brute(vecs, [0, 100, 200, 300], 5)
    assert set(got) == set(want)
    assert all([j for _, j in got[i]] == [j for _, j in want[i]] for i in want)
    assert A.nearest(df.limit(0), df.limit(0)).count() == 0


def test_repeated_queries_lengths_and_clashing_columns(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(3 if i % 3 else 2).astype(np.float32).tolist()) for i in range(120)]
    rows += [(100, rows[100][1]), (0, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("x")).withColumn("score", F.lit(1)).withColumn("ids", F.lit(2))
    for block in (1, 100):
        monkeypatch.setattr(A, "QUERY_BLOCK", block)
        got = {}
        for x in A.nearest(df, df.filter("vec_id % 20 = 0"), 6).collect():
            got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
        for q in range(0, 120, 20):
            of = np.array(min(v for i, v in rows if i == q), np.float64)
            want = sorted((float(np.sqrt(((np.array(v, np.float64) - of) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(of))[:6]
            assert [(got[q][k + 1][0], round(got[q][k + 1][1], 12)) for k in range(6)] == [(i, round(d, 12)) for d, i in want]


def test_shards_share_what_they_found():
    """With the k-th distance of other shards known, a shard verifies no more than without."""
    r = np.random.default_rng(1)
    v = r.standard_normal((600, 8))
    axes = A._axes(8)
    q_ids, q = np.array([1000]), v[:1] + 0.01
    shards = [A.Shard.build(np.arange(300) + 300 * i, v[300 * i : 300 * i + 300], axes) for i in range(2)]
    reach = np.full(1, np.inf)
    found = [x for s in shards for x in s.search(q_ids, q, axes, 5, reach)]
    got = sorted((d, i) for _, ids, ds in found for i, d in zip(ids, ds))[:5]
    want = sorted((float(np.sqrt(((x - q[0]) ** 2).sum())), i) for i, x in enumerate(v))[:5]
    assert [i for _, i in got] == [i for _, i in want] and reach[0] >= want[-1][0] - 1e-9
