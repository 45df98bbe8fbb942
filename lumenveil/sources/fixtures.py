"""Benchmark fixtures in JSON: tasks with chunks, labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "cases array<struct<id:string,label:string,category:string,text:string>>"
TASKS = "tasks array<struct<id:string,task:string,task_language:string,cross_lingual:boolean,recommended_k:int,chunks:array<struct<id:string,source:string,label:string,text:string>>>>"


def labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(CASES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.select(F.explode("cases").alias("c")).select("c.*")


def relevance_chunks(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(TASKS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    tasks = df.select(F.explode("tasks").alias("t"))
    return tasks.select(F.col("t.id").alias("task_id"), "t.task", "t.cross_lingual", "t.recommended_k", F.explode("t.chunks").alias("c")).select("task_id", "task", "cross_lingual", "recommended_k", F.col("c.id").alias("chunk_id"), "c.source", "c.label", "c.text")
