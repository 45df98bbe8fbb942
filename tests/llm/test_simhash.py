import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenveil.llm import simhash as S


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one TWO", "a b c", "ÀB é x y z", "w " * 5000, "x" * 100000])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fp(text)


def test_forest_finds_what_brute_force_finds():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = []
    for _ in range(600):
        x = int(base[rng.integers(20)])
        for _ in range(rng.integers(0, 6)):
            x ^= 1 << int(rng.integers(64))
        fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    shard = np.sort(rng.integers(0, 3, len(fps)))
    got = {p for a, b in S.Forest(fps, shard).links(3) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(fps)) for j in range(i) if shard[i] == shard[j] and bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3}
    assert got == want


def _fps(spark, values):
    signed = [int(np.array([v], np.uint64).view(np.int64)[0]) for v in values]
    return spark.createDataFrame([(v,) for v in signed], "fp bigint")


@pytest.mark.parametrize("most", [20_000, 3])
def test_components_over_shards(spark, monkeypatch, most):
    """Also with shards so small that every one is split again."""
    monkeypatch.setattr(S, "SHARD_MOST", most)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 15, dtype=np.uint64)
    fps = sorted({int(base[i % 15]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for i in range(150)})
    rows = S._shards(_fps(spark, fps)).repartition(3, "shard").sortWithinPartitions("shard", "fp")
    labels = {r["node"]: r["root"] for r in S.components(rows.mapInArrow(S._search, "a bigint, b bigint")).collect()}
    signed = [int(np.array([v], np.uint64).view(np.int64)[0]) for v in fps]
    got = [labels.get(s, s) for s in signed]
    want = brute_components(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (got[i] == got[j]) == (want[i] == want[j])


def test_long_chain_becomes_one_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)], "a bigint, b bigint")
    assert {r["root"] for r in S.components(links).collect()} == {0}


def test_near_duplicates(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (3, text), (9, text + " tail"), (1, "other words here entirely different " * 9), (2, ""), (4, None), (4, None), (7, "  ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    got = {}
    out = S.near_duplicates(df).collect()
    assert len(out) == len(rows)
    for r in out:
        got[r["doc_id"]] = (r["fingerprint"], r["component_id"])
    fps = {i: brute_fp(t) for i, t in rows}
    assert all(got[i][0] == f"{fps[i]:016x}" for i in fps)
    ids = sorted(fps)
    comp = brute_components([fps[i] for i in ids])
    assert all(got[i][1] == ids[c] for i, c in zip(ids, comp))
    assert S.near_duplicates(df.limit(0)).count() == 0
