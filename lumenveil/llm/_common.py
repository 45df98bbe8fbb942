"""Shared plumbing: table loading, written cut points in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Above these a table is never broadcast; the caller's shuffle join is used instead.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own, but never on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lumenveil-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint only if the (already materialized) table is small; else df as it is, for a shuffle join.

    row_bytes: an upper bound on a row's size.
    """
    most = min(BROADCAST_ROWS, BROADCAST_BYTES // max(1, row_bytes))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def add_columns(docs: DataFrame, text_col: str, fields: list[tuple[str, str]], make) -> DataFrame:
    """docs plus columns computed from the whole text. fields: (name, DDL type), replacing columns of those names.

    make() is called once in each task and gives a function from a list of texts (or None) to a list of
    rows of new values.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    new = [n for n, _ in fields]
    kept = [f for f in docs.schema.fields if f.name not in new]
    types = [to_arrow_type(_parse_datatype_string(t)) for _, t in fields]
    names = [f.name for f in kept]
    at = names.index(text_col)

    def run(batches):
        work = make()
        for batch in batches:
            rows = work(batch.column(at).to_pylist())
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *new])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` {t}" for n, t in fields])
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def bounded_sample(labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most `most` rows of labels, the same ones whatever the partitioning."""
    return labels.orderBy(F.xxhash64(id_col), id_col).limit(most)


def labelled_features(docs: DataFrame, sample: DataFrame, encode, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, features) of the sampled rows' texts, encoded where they are read: encode(text or None) -> bytes.

    sample: (doc_id, label), bounded. An id that several rows or labels have gives one row, that with the smallest features
    and the larger label, so that the result has no more rows than the sample. No text leaves its task.
    """
    import pyarrow as pa

    ids = sample.select(F.col("doc_id").alias("_doc_id"), F.col("label").cast("int").alias("_label")).groupBy("_doc_id").agg(F.max("_label").alias("_label"))
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            made = [encode(cell.as_py()) for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["doc_id", "label", "features"])

    met = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("_doc_id")).select("doc_id", F.col("_label").alias("label"), "text")
    rows = met.mapInArrow(run, f"doc_id {id_type}, label int, features binary")
    return rows.groupBy("doc_id", "label").agg(F.min("features").alias("features"))


def fit_in_one_task(sample: DataFrame, fit) -> bytes:
    """fit(rows as a list of dicts) -> bytes, run in one executor task. The sample must be bounded."""
    import pyarrow as pa

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows)], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(made["model"]) if made is not None else fit([])  # no rows, no task


def running(array: str, size: str, step: str) -> str:
    """Running values of an array of numbers by log2(size) doubling steps. step: of x and the value p so far before it."""
    shift = "cast(shiftleft(1, r) AS int)"
    once = f"transform(s, (x, i) -> if(i < {shift}, x, {step.replace('p', f'get(s, i - {shift})')}))"
    return f"if({size} < 2, {array}, aggregate(sequence(0, cast(ceil(log2({size})) AS int) - 1), {array}, (s, r) -> {once}))"
