"""Quality metrics: classification, retrieval, nearest-rank percentiles, comparison of variants, leak counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import cumulated
from ..functions.shared import written


def classification(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """tp, fp, tn, fn, precision, recall (null without a denominator, six places). label, predicted: boolean SQL."""
    n = lambda test: F.count_if(F.expr(test)).alias
    c = rows.agg(n(f"({label}) AND ({predicted})")("tp"), n(f"NOT ({label}) AND ({predicted})")("fp"), n(f"NOT ({label}) AND NOT ({predicted})")("tn"), n(f"({label}) AND NOT ({predicted})")("fn"))
    ratio = lambda d: F.when(d > 0, F.bround(F.col("tp") / d, 6))
    return c.select("*", ratio(F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp") + F.col("fn")).alias("recall"))


def retrieval(rows: DataFrame, k: int, task: str = "task", source: str = "source", order: tuple = (), relevant: str = "relevant") -> DataFrame:
    """Per task: recall and precision of the first k distinct sources in rank order, and the reciprocal rank of the first relevant one."""
    best = rows.groupBy(task, source).agg(F.min(F.struct(*order)).alias("_o"), F.max(relevant).alias("_r"))
    ranked = best.withColumn("_n", F.row_number().over(Window.partitionBy(task).orderBy("_o", source)))
    got = ranked.groupBy(task).agg(
        F.count_if(F.col("_r")).alias("_all"), F.count_if(F.col("_r") & (F.col("_n") <= k)).alias("_hit"), F.count_if(F.col("_n") <= k).alias("_top"), F.min(F.when(F.col("_r"), F.col("_n"))).alias("_first")
    )
    return got.select(
        task, F.when(F.col("_all") > 0, F.col("_hit") / F.col("_all")).alias("recall_at_k"), (F.col("_hit") / F.col("_top")).alias("precision_at_k"),
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def nearest_rank(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """The value at rank ceil(p n) of each group; exact, and no group meets in one task."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    run = written(cumulated(counts, group, [value], "_c", "_upto", "ranks"), "upto")
    sizes = run.groupBy(group).agg(F.max("_upto").alias("_n"))
    at = F.greatest(F.lit(1), F.ceil(F.bround(F.lit(p) * F.col("_n"), 9)))
    hit = run.join(sizes, group).filter((F.col("_upto") >= at) & (F.col("_upto") - F.col("_c") < at))
    return hit.select(group, F.col(value).alias("percentile"))


def compare(rows: DataFrame, metric: str, variant: str, a: str, b: str, value: str, passed: str) -> DataFrame:
    """metric, delta (b - a), withheld (null) unless both variants passed everywhere."""
    wide = rows.groupBy(metric).agg(
        F.max(F.when(F.col(variant) == a, F.col(value))).alias("_a"), F.max(F.when(F.col(variant) == b, F.col(value))).alias("_b"), F.min(F.col(passed)).alias("_ok")
    )
    return wide.select(metric, F.when(F.col("_ok"), F.bround(F.col("_b") - F.col("_a"), 6)).alias("delta"))


def forbidden_values(docs: DataFrame, listed: list[str], text: str = "text") -> DataFrame:
    """Distinct values that no output may hold: listed ones, right sides of NAME=value lines, e-mail addresses and phone numbers of CSV rows."""
    from ..functions.text import lit, rx
    from ..functions import fixed

    env = f"filter(transform(regexp_extract_all({text}, {lit('(?m)^[A-Z][A-Z0-9_]*=(.+)$')}, 1), v -> trim(v)), v -> v <> '')"
    mail, phone = f"regexp_extract_all({text}, {rx(fixed.EMAIL)}, 0)", f"regexp_extract_all({text}, {rx(fixed.PHONES[0])}, 0)"
    own = docs.sparkSession.createDataFrame([(v,) for v in listed], "value string")
    return docs.select(F.explode(F.expr(f"concat({env}, {mail}, {phone})")).alias("value")).unionByName(own).distinct()


def count_present(values: DataFrame, outputs: list[str], value: str = "value") -> int:
    """How many distinct values an output surface holds. The outputs are few and small; the values may be many."""
    hay = [o.lower() for o in outputs]
    test = F.lit(False)
    for h in hay:
        test = test | F.lit(h).contains(F.lower(F.col(value)))
    return values.select(value).distinct().filter(test).count()
