"""Training-data pipeline over `documents`: five stages, each an operator of lumenveil.llm.

toxicity: documents that the classifier chain rejects go. dedup: of each group of near copies the document with
the smallest doc_id stays, one without an id only where all lack it. decontaminate: documents that hold a whole window of
a benchmark item go, however long they are, and those of whose words items shorter than a window make up too many. pii:
personal data in the texts becomes [KIND]. packing: what is left becomes token pieces with their places in sequences.

Each stage's defined cases are its operator's. Null ids and texts, repeated rows, very long texts and extra columns pass
through every stage but the last, which replaces the columns by the pieces'. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.llm import decontaminate as _decontaminate
from lumenveil.llm import packing as _packing
from lumenveil.llm import pii as _pii
from lumenveil.llm import simhash as _simhash
from lumenveil.llm import toxicity as _toxicity
from lumenveil.llm._common import materialize, table

#: SQL has neither the models nor the packing search; the stages are tested against brute-force versions.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = _toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _toxicity.score(docs, model).filter(~F.col("toxic")).select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the smallest doc_id's, null ids last, then the smallest by two hashes of the whole row.

    Rows are told apart by id and hashes, so texts that share an id, or have none, are decided each for itself.
    """
    of_row = [F.xxhash64(*docs.columns).alias("h1"), F.xxhash64(F.lit(1), *docs.columns).alias("h2")]
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), *of_row)
    of = _simhash.near_duplicates(docs.select(key.alias("row"), "text"), "row")
    kept = materialize(of.filter(F.col("doc_id") == F.col("component_id")).select("doc_id.id", "doc_id.h1", "doc_id.h2"), "kept")
    # One plan at every size: the rows meet by key in a sorted shuffle, never by a broadcast of all keys.
    rows = docs.select("*", *(h.alias(f"_{n}") for h, n in zip(of_row, ("h1", "h2"))))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2"))
    out = rows.join(kept.distinct().hint("merge"), same, "left_semi")
    # Rows alike in every column are one document.
    repeated = not kept.groupBy("id", "h1", "h2").count().filter("count > 1").isEmpty()
    return (out.dropDuplicates(["doc_id", "_h1", "_h2"]) if repeated else out).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark passage of a whole window; a share of hits is asked for only where items are shorter."""
    names = ("n_words", "n_hit", "items", "spans", "full_window")
    # Columns of the caller's with the results' names stay.
    kept = {n: f"_{i}_{n}" for i, n in enumerate(docs.columns) if n in names}
    got = _decontaminate.decontaminate(docs.withColumnsRenamed(kept), table(spark, sf_dir, "benchmark"))
    short = (F.col("n_hit") > 0) & (F.col("n_hit") * _decontaminate.SHARE >= F.col("n_words"))
    left = got.filter(~(F.col("full_window") | short)).drop(*names)
    return left.withColumnsRenamed({v: k for k, v in kept.items()}).select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("dedup", dedup), ("decontaminate", decontaminate), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
