"""Counts, risk, decisions and public findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import blocks, empty, line_in_blocks, lines_before, lit, rx, split_lines

SEVERITY = (
    "CASE WHEN f.type IN ('EMAIL', 'PHONE', 'IPV4') THEN 'medium' WHEN f.type IN ('CHINESE_ID', 'PROMPT_INJECTION') THEN 'high' ELSE 'critical' END"
)
ACTION = "CASE f.sensitivity WHEN 'secret' THEN 'REDACT' WHEN 'pii' THEN 'PSEUDONYMIZE' ELSE 'ISOLATE' END"
DETECTOR = "if(f.sensitivity = 'instruction', 'heuristic', 'regex')"


def public_findings(docs: DataFrame, source: str = "path", text: str = "text", findings: str = "findings") -> DataFrame:
    """type, severity, source, line, detector, action of every finding: never its value."""
    df = docs.select(F.col(source).alias("source"), F.col(findings).alias("f"), F.expr(f"if(size({findings}) = 0, {empty('string')}, {blocks(text)})").alias("b"))
    df = df.withColumn("n", F.expr(lines_before("b")))
    rows = df.select(
        "source",
        F.explode_outer(F.expr(
            f"transform(f, f -> struct(f.type AS type, {SEVERITY} AS severity, {line_in_blocks('b', 'n', 'f.start')} AS line, {DETECTOR} AS detector, {ACTION} AS action))"
        )).alias("x"),
    )
    return rows.filter("x IS NOT NULL").select("x.type", "x.severity", "source", "x.line", "x.detector", "x.action")


def sorted_findings(public: DataFrame) -> DataFrame:
    return public.orderBy("source", "line", "type", "action")


def security_summary(docs: DataFrame, source: str = "path", findings: str = "findings") -> DataFrame:
    """One row of 15 counters; instructions that share a span count once."""
    per = [F.expr(f"size(filter({findings}, f -> f.type IN ({', '.join(map(lit, types))})))").alias(name) for name, types in fixed.SUMMARY.items()]
    blocked = f"size(array_distinct(transform(filter({findings}, f -> f.sensitivity = 'instruction'), f -> struct(f.start, f.end))))"
    rows = docs.select(*per, F.expr(blocked).alias("blocked_instructions"))
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in rows.columns])


def risk(findings: str = "findings") -> Column:
    """Of one row's findings."""
    has = lambda test: f"exists({findings}, f -> {test})"
    return F.expr(
        f"CASE WHEN {has(lit('PRIVATE_KEY') + ' = f.type')} THEN 'CRITICAL' WHEN {has("f.sensitivity IN ('secret', 'instruction')")} THEN 'HIGH' "
        f"WHEN {has("f.sensitivity = 'pii'")} THEN 'MEDIUM' ELSE 'LOW' END"
    )


def decision(findings: str = "findings") -> Column:
    return F.expr(f"if(size({findings}) > 0, 'ALLOW_WITH_TRANSFORM', 'ALLOW')")


RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def corpus_risk(docs: DataFrame, findings: str = "findings") -> DataFrame:
    """decision and risk_level of a whole corpus."""
    level = F.array_position(F.array(*map(F.lit, RISKS)), risk(findings))
    worst = docs.agg(F.max(level).cast("int").alias("n"), F.max(F.size(findings)).alias("most"))
    return worst.select(
        F.when(F.coalesce("most", F.lit(0)) > 0, "ALLOW_WITH_TRANSFORM").otherwise("ALLOW").alias("decision"),
        F.element_at(F.array(*map(F.lit, RISKS)), F.coalesce("n", F.lit(1))).alias("risk_level"),
    )


def has_safe_content(text: str) -> str:
    """Whether a line is neither blank nor the isolation mark alone."""
    return f"exists({split_lines(text)}, l -> NOT regexp_replace(l, {lit('(?U)^' + chr(92) + 's+|' + chr(92) + 's+$')}, '') IN ('', {lit(fixed.ISOLATED)}))"


def task_blocked(task: str) -> str:
    """Whether a task asks to gather secrets and send them out."""
    return "(" + " OR ".join(f"{task} rlike {rx(p)}" for p in fixed.TASK_BLOCK) + ")"


def corpus_stats(docs: DataFrame, bytes_col: str) -> DataFrame:
    return docs.agg(F.count("*").alias("inspected"), F.coalesce(F.sum(bytes_col), F.lit(0)).alias("total_bytes"))


def reduction(tokens: str, original: str) -> str:
    """1 - tokens / original, to 6 places half-even, 0 where there was nothing."""
    return f"if({original} = 0, 0D, bround(1 - {tokens} / {original}, 6))"
