"""Errors with fixed, input-independent codes and messages."""

from __future__ import annotations

from .functions.fixed import ERRORS


class EngineError(Exception):
    code = "ENGINE_ERROR"

    def __init__(self) -> None:
        super().__init__(ERRORS[self.code])

    @property
    def public_message(self) -> str:
        return ERRORS[self.code]


def _kind(code: str) -> type[EngineError]:
    return type("".join(p.title() for p in code.split("_")), (EngineError,), {"code": code})


InputIncomplete = _kind("INPUT_INCOMPLETE")
InputPathNotFound = _kind("INPUT_PATH_NOT_FOUND")
InputPermissionDenied = _kind("INPUT_PERMISSION_DENIED")
AuditLogWriteFailed = _kind("AUDIT_LOG_WRITE_FAILED")
RuntimeUnavailable = _kind("RUNTIME_UNAVAILABLE")
InvalidConfiguration = _kind("INVALID_CONFIGURATION")
InvalidArguments = _kind("INVALID_ARGUMENTS")
TaskBlocked = _kind("TASK_BLOCKED")
NoSafeContext = _kind("NO_SAFE_CONTEXT")
PolicyLimitExceeded = _kind("POLICY_LIMIT_EXCEEDED")
LeakageGuardFailed = _kind("LEAKAGE_GUARD_FAILED")
InferenceUnavailable = _kind("INFERENCE_UNAVAILABLE")


def envelope(error: BaseException) -> dict:
    """The public form of an error; anything unknown is INTERNAL_ERROR."""
    code = error.code if isinstance(error, EngineError) else "INTERNAL_ERROR"
    return {"schema_version": "0.1", "error": {"code": code, "message": ERRORS[code]}}
