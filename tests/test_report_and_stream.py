import json

import pytest
from pyspark.sql import functions as F

from lumenveil.errors import LeakageGuardFailed
from lumenveil.plans.report import write_report
from lumenveil.streaming import microbatch


def test_report_is_written_unless_it_holds_a_forbidden_value(spark, tmp_path):
    report = {"status": "PASS", "security": {"recall": 1.0, "precision": 0.5}, "mode": "rules"}
    values = spark.createDataFrame([("Jane-Secret",)], "value string")
    made, text = write_report(report, tmp_path / "out", values)
    assert json.loads(made.read_text()) == report
    assert text.read_text() == "# Benchmark\n\n- mode: `rules`\n- status: `PASS`\n\n## security\n\n- precision: `0.5`\n- recall: `1.0`\n"
    with pytest.raises(LeakageGuardFailed):
        write_report(report | {"note": "by jane-SECRET"}, tmp_path / "none", values)
    assert not (tmp_path / "none").exists()


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    rows = [(f"f{i}", f"mail a{i}@x.example.org\nok", f"2024-01-01 00:0{i}:00") for i in range(4)]
    docs = spark.createDataFrame(rows, "path string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    docs.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    write = lambda batch, n: microbatch.write_idempotent(batch, n, f"{tmp_path}/out")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = microbatch.findings_stream(docs)
    columns = want.columns
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.collect()))
    counts = microbatch.counts_by_window(docs).collect()
    assert sum(r["n"] for r in counts) == 4 and {r["type"] for r in counts} == {"EMAIL"}
