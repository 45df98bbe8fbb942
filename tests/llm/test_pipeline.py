import corpus_pipeline as P
from lumenveil.llm import simhash as S

from .test_decontaminate import brute
from .test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = P.dedup(spark, docs, SF)
    assert kept.columns == columns
    ids = sorted(texts)
    comp = brute_components([brute_fp(texts[i]) for i in ids])
    want = {ids[c] for c in comp}
    assert {r["doc_id"] for r in kept.collect()} == want

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = P.decontaminate(spark, kept, SF)
    left = {r["doc_id"] for r in clean.collect()}
    for i in list(want)[:60]:
        assert (i in left) == (not brute(texts[i], items)[1])  # no item is shorter than a window here
    assert clean.columns == columns

    masked = P.pii(spark, clean, SF).collect()
    assert {r["doc_id"] for r in masked} == left and all(r["n_chars"] == len(r["text"]) for r in masked)
    packed = P.packing(spark, clean, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == left


def test_decontaminate_by_windows_and_by_share(spark, tmp_path):
    long, short = " ".join(f"w{i}" for i in range(20)), "two words"
    spark.createDataFrame([(1, long), (2, short)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["clean " * 5000 + long, "clean " * 5000 + short, "here two words", long[:60], None, "", "clean " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'own' AS n_hit", "doc_id AS items")
    got = P.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and {(r["doc_id"], r["n_hit"], r["items"]) for r in got.collect()} == {(i, "own", i) for i in (1, 4, 5, 6)}


def test_toxicity_stage_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = P.toxicity(spark, docs, sf)
    assert out.columns == docs.columns
    left = {r["doc_id"] for r in out.select("doc_id").collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in left for i in clean) >= 0.99 * len(clean)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "same text here", "en", "s", 14), (1, "same text here", "en", "s", 14), (2, "same text here", "en", "s", 14), (None, "another one", "en", "s", 11), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in P.dedup(spark, docs, SF).collect())
    assert got == [(False, 1), (False, 3), (True, 0)]
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        assert stage(spark, docs, SF).count() >= 1, name


def test_texts_that_share_an_id_or_have_none_are_kept(spark):
    texts = ["the first of several quite different texts", "weather reports speak of rain in the north", "seven bakers sold bread at the old market", "nothing of this resembles any other row"]
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (None, texts[1], "b"), (5, texts[2], "a"), (5, texts[3], "a"), (6, texts[2], "a"), (None, texts[3], "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = P.dedup(spark, docs, SF).collect()
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3])]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_run(spark):
    out = P.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 50
    assert S.RADIUS == 3
