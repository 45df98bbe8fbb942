"""Policies: strict YAML with fixed keys. Secrets can only be redacted, the block flags only be true."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ..errors import InvalidConfiguration
from ..functions import fixed


@dataclass(frozen=True)
class Policy:
    name: str = "developer-default"
    pii: str = "pseudonymize"
    secrets: str = "redact"
    internal_ips: str = "pseudonymize"
    max_capsule_tokens: int = fixed.MAX_CAPSULE_TOKENS
    max_files: int = fixed.MAX_FILES
    max_file_bytes: int = fixed.MAX_FILE_BYTES
    max_total_bytes: int = fixed.MAX_TOTAL_BYTES


_MODES = ("pseudonymize", "redact")


def _exactly(value: object, required: set[str], optional: frozenset = frozenset()) -> dict:
    if not isinstance(value, dict) or not required <= set(value) <= required | optional:
        raise InvalidConfiguration()
    return value


def policy_from(data: object) -> Policy:
    body = _exactly(_exactly(data, {"policy"})["policy"], {"name", "transform", "block", "limits"})
    name = body["name"]
    modes = _exactly(body["transform"], {"pii", "secrets", "internal_ips"})
    flags = _exactly(body["block"], {"private_keys", "prompt_injection", "credential_values"})
    limits = _exactly(body["limits"], {"max_capsule_tokens", "max_files"}, frozenset({"max_file_bytes", "max_total_bytes"}))
    fine = (
        isinstance(name, str) and name.strip() and len(name) <= 128
        and modes["pii"] in _MODES and modes["internal_ips"] in _MODES and modes["secrets"] == "redact"
        and all(v is True for v in flags.values())
        and all(type(v) is int and v > 0 for v in limits.values())
    )
    if not fine:
        raise InvalidConfiguration()
    policy = Policy(name.strip(), modes["pii"], "redact", modes["internal_ips"], **limits)
    if policy.max_total_bytes < policy.max_file_bytes:
        raise InvalidConfiguration()
    return policy


def load_policy(path: str | Path | None = None) -> Policy:
    """The default without a path; else the file, which must be regular, no link, UTF-8 and valid."""
    if path is None:
        return Policy()
    try:
        import yaml
    except ModuleNotFoundError:
        yaml = None
    try:
        file = Path(path)
        if file.is_symlink() or not file.is_file():
            raise InvalidConfiguration()
        raw = file.read_text(encoding="utf-8-sig")
        if yaml is None:
            import json

            return policy_from(json.loads(raw))
        return policy_from(yaml.safe_load(raw))
    except InvalidConfiguration:
        raise
    except Exception:
        raise InvalidConfiguration() from None
