"""Benchmark reports: JSON and Markdown side by side, refused where they would hold a forbidden value."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from ..errors import LeakageGuardFailed
from ..operators import metrics


def markdown(title: str, report: dict) -> str:
    """Sections of the report's maps, a line for each value; other values stand under the title."""
    own = [f"- {k}: `{v}`" for k, v in sorted(report.items()) if not isinstance(v, dict)]
    parts = [f"# {title}", "", *own, ""]
    for name, section in sorted((k, v) for k, v in report.items() if isinstance(v, dict)):
        parts += [f"## {name}", "", *(f"- {k}: `{v}`" for k, v in sorted(section.items())), ""]
    return "\n".join(parts)


def write_report(report: dict, folder: str | Path, forbidden: DataFrame, title: str = "Benchmark") -> tuple[Path, Path]:
    """latest.json and latest.md in the folder. forbidden: a table (value), looked up on the executors before anything is written."""
    body = json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    text = markdown(title, report)
    if metrics.count_present(forbidden, [body, text]):
        raise LeakageGuardFailed()
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for name, content in (("latest.json", body), ("latest.md", text)):
        (out / name).write_text(content, encoding="utf-8")
    return out / "latest.json", out / "latest.md"
