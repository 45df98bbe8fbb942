import re

from pyspark.sql import functions as F

from lumenveil.llm import decontaminate as D


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        for k in range(max(1, len(b) - 12) if b else 0):
            g = b[k : k + 13]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(i)
    return len(w), len(hit), sorted(found, key=str)


def test_equals_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Short item, here!"), (3, ""), (4, None), (10, long.upper()), (5, "é ü1 x")]
    texts = [None, "", "!!!", "before " + long + " after", "short ITEM here short item here", "w3-w4_w5 " * 3, " ".join(f"w{i}" for i in range(5, 20)), "xshort item here", "É É é ü1 x", "a " * 50000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_words", F.lit("clash")).withColumn("extra", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    got = {r["doc_id"]: r for r in D.decontaminate(docs, bench).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == brute(t, items), t
        inside = sum(len(words(t[s["start"] : s["end"]])) for s in got[i]["spans"])
        assert inside == got[i]["n_hit"]
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    items = [(i, " ".join(f"k{i}x{j}" for j in range(15))) for i in range(6)]
    docs = spark.createDataFrame([(1, items[0][1] + " z " + items[5][1])], "doc_id bigint, text string")
    r = D.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string")).first()
    assert r["items"] == [0, 5] and r["n_hit"] == 30


def test_blocks_equal_one_automaton(spark, monkeypatch):
    items = [(i, " ".join(f"k{i % 4}x{j % 7}" for j in range(3 + 2 * i))) for i in range(12)] + [(90, None), (91, "")]
    texts = [None, "", *(items[i][1] + " z " + items[11 - i][1].upper() for i in range(12)), " ".join(t or "" for _, t in items) * 20]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id bigint, text string, row string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole = order(D.decontaminate(docs, bench))
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    assert order(D.decontaminate(docs, bench)) == whole
    for i, t, _, n, hit, found, _, full in whole:
        assert (n, hit, found) == brute(t, items)
        assert full == bool(brute(t, [x for x in items if len(words(x[1])) >= 13])[1])
