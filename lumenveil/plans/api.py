"""scan, analyze and health over a corpus: files or a table."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AuditLogWriteFailed, InferenceUnavailable, InputIncomplete, InvalidConfiguration, LeakageGuardFailed
from ..functions import fixed
from ..functions.shared import written
from ..operators import capsule as C
from ..operators import detect, gate, hybrid, lexical, summary, transform
from ..sources.files import Corpus, Limits, from_table, load_path
from ..sources.policy import Policy, load_policy

VERSION = "0.1.0"
#: Embeds texts: (list of texts, "query" or "passage") -> list of vectors. Runs in the executors' Python workers.
Embed = Callable[[list[str], str], list[list[float]]]


def health() -> dict:
    return {"schema_version": fixed.SCHEMA_VERSION, "status": "ok", "version": VERSION, "commands": ["health", "scan", "analyze"], "inference": gate.RULES_INFERENCE}


class Workspace:
    """A corpus after detection and transformation; its tables stay on the executors."""

    def __init__(self, spark: SparkSession, corpus: Corpus, policy: Policy, task: str | None = None):
        found = written(detect.detect_all(corpus.docs.select("path", "text")), "findings")
        self.files = {"inspected": corpus.inspected, "skipped": corpus.skipped, "total_bytes": corpus.total_bytes}
        self.security = {k: int(v) for k, v in summary.security_summary(found).first().asDict().items()}
        level = summary.corpus_risk(found).first()
        self.decision, self.risk_level = level["decision"], level["risk_level"]
        # Occurrences count by the task, then by path: a path before its content.
        content = found.select(F.lit(1).alias("layer"), "path", F.lit(1).alias("part"), "text", "findings")
        names = detect.detect_all(found.select(F.lit(1).alias("layer"), "path", F.lit(0).alias("part"), F.col("path").alias("text")))
        every = content.unionByName(names)
        if task is not None:
            own = spark.createDataFrame([(0, "", 0, task)], "layer int, path string, part int, text string")
            every = every.unionByName(detect.detect_all(own))
        done = written(transform.pseudonymize(every, ["layer", "path", "part"], pii=policy.pii, ips=policy.internal_ips), "transformed")
        self.task = done.filter("layer = 0").select("transformed").first()["transformed"] if task is not None else None
        safe = done.filter("layer = 1 AND part = 0").select("path", F.col("transformed").alias("safe"))
        self.sources = transform.unique_sources(safe, "safe", "path").select("path", "source")
        text = done.filter("layer = 1 AND part = 1").select("path", F.col("transformed").alias("text"))
        self.transformed = text.join(self.sources, "path").select("source", "text")
        self.values = done.select(F.explode("originals").alias("value")).distinct()
        public = summary.public_findings(found)
        self.findings = public.withColumnRenamed("source", "path").join(self.sources, "path").drop("path")

    def has_content(self) -> bool:
        return not self.transformed.filter(summary.has_safe_content("text")).limit(1).isEmpty()


def _detector(spark: SparkSession) -> Callable[[list[str]], list[tuple[int, int, int, str]]]:
    def run(texts: list[str]) -> list[tuple[int, int, int, str]]:
        if not texts:
            return []
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        # An explode would have the optimizer push a test of all detection below it.
        rows = detect.detect_all(df).select("i", F.expr("transform(findings, f -> struct(f.start, f.end, f.sensitivity))").alias("f")).collect()
        return [(r["i"], *f) for r in rows for f in r["f"]]

    return run


def _release(spark: SparkSession, result: dict, values: DataFrame, audit: Path | None, event: dict) -> dict:
    """The result, if the gate finds nothing in it and in the audit event; else an error, and nothing is written."""
    texts = gate.leaves(result) + gate.leaves(event)
    known = gate.relevant_values(values, texts)
    run = _detector(spark)
    for payload in (result, event):
        got = gate.inspect(payload, known, run(gate.leaves(payload)))
        reported = payload.get("privacy", {}).get("raw_sensitive_spans_forwarded", got["sensitive"])
        if any(got.values()) or reported != got["sensitive"]:
            raise LeakageGuardFailed()
    if gate.leaks([C.stable_json(result), C.stable_json(event)], known):
        raise LeakageGuardFailed()
    if audit is not None:
        try:
            audit.parent.mkdir(parents=True, exist_ok=True)
            with audit.open("a", encoding="utf-8", newline="\n") as f:
                f.write(C.stable_json(event) + "\n")
        except OSError:
            raise AuditLogWriteFailed() from None
    return result


def _event(operation: str, work: Workspace, decision: str, risk: str, began: float, mode: str) -> dict:
    return {
        "schema_version": fixed.SCHEMA_VERSION, "timestamp": datetime.now(UTC).isoformat(timespec="seconds"), "operation": operation, "status": "success",
        "files_inspected": work.files["inspected"], "files_skipped": work.files["skipped"], "decision": decision, "risk_level": risk, "security": work.security,
        "inference_mode": mode, "duration_ms": max(0, int(1000 * (time.monotonic() - began))),
    }


def audit_target(audit: str | Path | None, root: str | Path) -> Path | None:
    """The log's path, which must lie outside what is scanned."""
    if audit is None:
        return None
    log, top = Path(audit).expanduser().resolve(), Path(root).expanduser().resolve()
    if log.is_relative_to(top if top.is_dir() else top.parent):
        raise InputIncomplete()
    return log


def _corpus(spark: SparkSession, source: str | Path | DataFrame, policy: Policy, audit) -> tuple[Corpus, Path | None]:
    if isinstance(source, DataFrame):
        return from_table(source), Path(audit) if audit else None
    log = audit_target(audit, source)
    return load_path(spark, source, Limits(policy.max_files, policy.max_file_bytes, policy.max_total_bytes)), log


def scan(spark: SparkSession, source: str | Path | DataFrame, policy_path=None, audit_log=None) -> dict:
    """The report on a corpus. Findings are listed in it, as the contract has it, and come to the driver: a large table calls for scan_table()."""
    began, policy = time.monotonic(), load_policy(policy_path)
    corpus, log = _corpus(spark, source, policy, audit_log)
    work = Workspace(spark, corpus, policy)
    rows = summary.sorted_findings(work.findings).collect()
    report = {
        "schema_version": fixed.SCHEMA_VERSION, "decision": work.decision, "risk_level": work.risk_level, "files": work.files, "findings": [r.asDict() for r in rows],
        "security": work.security, "inference": gate.RULES_INFERENCE,
    }
    return _release(spark, report, work.values, log, _event("scan", work, work.decision, work.risk_level, began, "deterministic_rules"))


def scan_table(docs: DataFrame) -> DataFrame:
    """Public findings of a table (path, text) of any size, as a table."""
    return summary.public_findings(detect.detect_all(docs))


def _embedded(df: DataFrame, column: str, embed: Embed) -> DataFrame:
    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        out: list = []
        for lo in range(0, len(texts), 32):
            out += [list(map(float, v)) for v in embed(texts[lo : lo + 32].tolist(), "passage")]
        return pd.Series(out)

    return df.withColumn("vector", vectors(column))


def rank_hybrid(work: DataFrame, task: str, embed: Embed, max_tokens: int, reserved: int, max_facts: int = fixed.MAX_FACTS) -> tuple[list, str, int]:
    """(facts, status, number of candidates) for transformed documents (source, text)."""
    cands = written(hybrid.candidates(work), "candidates")
    n = cands.count()
    if hybrid.over_limit(cands):
        raise InputIncomplete()
    if not task.strip() or not n:
        return [], "NO_RELEVANT_CONTEXT", n
    try:
        query = list(map(float, embed([task], "query")[0]))
        diagnostic = hybrid.is_diagnostic(task)
        calibration = None
        q = "array(" + ", ".join(f"{x!r}D" for x in query) + ")"
        if diagnostic:
            sims = written(_embedded(hybrid.anchors(cands), "anchor", embed).withColumn("similarity", F.expr(hybrid.cosine("vector", q))).select("anchor", "similarity"), "anchors")
            calibration = hybrid.calibrate(sims)
        vectors = written(_embedded(cands, "text", embed), "vectors")
        if not vectors.filter(F.expr(f"{hybrid.cosine('vector', q)} IS NULL")).limit(1).isEmpty():
            raise InferenceUnavailable()
        ranked = written(hybrid.scored(vectors, task, query, calibration), "scored")
    except Exception:
        raise InferenceUnavailable() from None
    facts, _, n_scored = hybrid.select(ranked, max_tokens - reserved, diagnostic, max_facts)
    return facts, lexical.status(len(facts), n_scored), n


def analyze(spark: SparkSession, task: str, source: str | Path | DataFrame, policy_path=None, audit_log=None, embed: Embed | None = None, model: tuple[str, str] = ("", "")) -> dict:
    """A capsule of evidence for a task; embed makes the ranking hybrid."""
    began = time.monotonic()
    if not isinstance(task, str) or not task.strip():
        raise InvalidConfiguration()
    policy = load_policy(policy_path)
    corpus, log = _corpus(spark, source, policy, audit_log)
    work = Workspace(spark, corpus, policy, task)
    blocked = spark.createDataFrame([(task,)], "task string").select(F.expr(summary.task_blocked("task"))).first()[0]
    stop = blocked or not work.has_content()
    decision, risk = ("BLOCK" if stop else work.decision), ("HIGH" if blocked else work.risk_level)
    evidence, warning, method, inference, mode = [], None, fixed.LEXICAL_METHOD, gate.RULES_INFERENCE, "deterministic_rules"
    if stop:
        warning = "TASK_BLOCKED" if blocked else "NO_SAFE_CONTEXT"
    else:
        if not lexical.check_sources(work.transformed).limit(1).isEmpty():
            raise InputIncomplete()
        reserved = min(1000, policy.max_capsule_tokens // 2)
        if embed is not None:
            evidence, state, n = rank_hybrid(work.transformed, work.task, embed, policy.max_capsule_tokens, reserved)
            method, mode = fixed.HYBRID_METHOD, "embedding"
            inference = {"chunks_processed": n, "device": "CPU", "fallback_state": "not_used", "mode": mode, "model_id": model[0], "model_revision": model[1], "embedding_available": True}
        else:
            windows = lexical.windows(lexical.scored_lines(work.transformed, work.task))
            evidence, _, n = lexical.select_facts(windows, policy.max_capsule_tokens - reserved)
            state = lexical.status(len(evidence), n)
        warning = None if evidence else state
    run = _detector(spark)
    evidence = [r.asDict() for r in evidence]
    # Detection doesn't depend on the capsule's shape: each leaf once.
    texts = list(dict.fromkeys([work.task, *(x for e in evidence for x in (e["text"], e["source"]))]))
    found: dict[str, list] = {}
    for i, a, b, s in run(texts):
        found.setdefault(texts[i], []).append((a, b, s))
    known = gate.relevant_values(work.values, texts)

    def inspect(payload: object) -> int:
        at = [(i, *x) for i, t in enumerate(gate.leaves(payload)) for x in found.get(t, [])]
        return gate.inspect(payload, known, at)["sensitive"]

    made = C.build(
        task=work.task, decision=decision, risk_level=risk, files=work.files, security=work.security, evidence=evidence, max_tokens=policy.max_capsule_tokens, inspect=inspect,
        warning=warning, method=method, inference=inference,
    )
    return _release(spark, made, work.values, log, _event("analyze", work, decision, risk, began, mode))


def human_report(command: str, result: dict) -> str:
    if command == "health":
        i = result["inference"]
        return "\n".join(("Status: ok", f"Version: {result['version']}", f"Mode: {i['mode']}", f"Embedding available: {'yes' if i['embedding_available'] else 'no'}"))
    files, security = result["files"], result["security"]
    lines = [
        f"Decision: {result['decision']}", f"Risk: {result['risk_level']}", f"Files inspected: {files['inspected']}", f"Files skipped: {files['skipped']}",
        f"API keys: {security['api_keys']}", f"DB credentials: {security['database_credentials']}", f"PII items: {security['pii_items']}",
        f"Prompt injections: {security['prompt_injections']}", f"Data exfiltration attempts: {security['data_exfiltration_attempts']}",
    ]
    if command == "analyze":
        context = result["safe_context"]
        lines.append("Safe context capsule:")
        lines += [f"- {f['source']}:{f['local_ref']} {f['text']}" for f in context["facts"]] or [f"- {context.get('coverage_warning', 'NO_RELEVANT_CONTEXT')}"]
    return "\n".join(lines)


def to_json(result: dict) -> str:
    return C.stable_json(json.loads(json.dumps(result)))
