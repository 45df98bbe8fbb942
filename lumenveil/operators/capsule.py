"""Capsules: a decision, its evidence and its own size, within a token budget."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from ..errors import PolicyLimitExceeded
from ..functions import fixed


def stable_json(value: object) -> str:
    """Sorted keys, no blanks, no ASCII escapes, no NaN."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def estimate_tokens(value: object) -> int:
    text = value if isinstance(value, str) else stable_json(value)
    return math.ceil(len(text.encode("utf-8", "surrogatepass")) / 4)


def local_ref(start: int, end: int) -> str:
    return f"L{start}" if start == end else f"L{start}-L{end}"


def settled(body: Callable[[int], dict]) -> dict:
    """body(n) for the n that is its own token estimate, or the twelfth try."""
    n, tries = 0, 0
    while True:
        made = body(n)
        after = estimate_tokens(made)
        tries += 1
        if after == n or tries == 12:
            return made
        n = after


def build(
    *,
    task: str,
    decision: str,
    risk_level: str,
    files: dict[str, int],
    security: dict[str, int],
    evidence: list[dict],
    max_tokens: int,
    inspect: Callable[[object], int],
    warning: str | None = None,
    method: str = fixed.LEXICAL_METHOD,
    inference: dict,
) -> dict:
    """The capsule with the most evidence, in rank order and passing over what doesn't fit.

    inspect: counts raw sensitive spans of a payload; it doesn't depend on the size, so it runs once for each try.
    """
    original = (files["total_bytes"] + 3) // 4

    def capsule(facts: list[dict], note: str | None) -> dict:
        context: dict = {"summary": None, "facts": facts, "selection_method": method}
        if note is not None:
            context["coverage_warning"] = note
        forwarded = inspect({"task": task, "safe_context": context})

        def body(n: int) -> dict:
            return {
                "schema_version": fixed.SCHEMA_VERSION, "task": task, "decision": decision, "risk_level": risk_level, "files": files, "safe_context": context, "security": security,
                "privacy": {"raw_sensitive_spans_forwarded": forwarded},
                "efficiency": {
                    "original_tokens_estimated": original, "capsule_tokens_estimated": n, "reduction_ratio": round(1 - n / original, 6) if original else 0.0, "estimator": fixed.ESTIMATOR,
                },
                "inference": inference,
            }

        return settled(body)

    note = None if evidence else warning
    best = capsule([], note)
    if estimate_tokens(best) > max_tokens:
        raise PolicyLimitExceeded()
    facts: list[dict] = []
    for e in evidence:
        fact = {"id": f"fact_{len(facts) + 1:03d}", "text": e["text"], "source": e["source"], "local_ref": local_ref(e["start_line"], e["end_line"]), "selection_score": e["score"]}
        trial = capsule([*facts, fact], None)
        if estimate_tokens(trial) <= max_tokens:
            facts.append(fact)
            best = trial
    return best
