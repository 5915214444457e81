"""One error type with a code, and how codes are presented."""

from __future__ import annotations

#: Codes by category; the category gives the HTTP status a service would answer with.
CATEGORIES = {
    "invalid": (400, ("INVALID_INPUT", "INVALID_OPTIONS", "INVALID_SNAPSHOT", "INVALID_MAPPING", "INVALID_RESULTS", "INVALID_OUTPUT", "INPUT_TOO_LARGE", "PARSE_FAILED", "OVERSIZED_CONTENT", "TOKEN_COUNT_FAILED")),
    "not_found": (404, ("NOT_FOUND",)),
    "conflict": (409, ("CONFLICT", "STALE_SOURCE", "INCONSISTENT_SPACE", "INVALID_ASSOCIATION")),
    "upstream": (502, ("ABORTED", "AUTHENTICATION", "RATE_LIMITED", "TIMEOUT", "DATABASE", "INCONSISTENT_BATCH", "INVALID_RESPONSE", "REFUSED", "TRUNCATED", "FILTERED")),
    "configuration": (503, ("NOT_CONFIGURED",)),
}
_BY_CODE = {code: (category, status) for category, (status, codes) in CATEGORIES.items() for code in codes}
RETRYABLE = frozenset(("RATE_LIMITED", "TIMEOUT", "DATABASE"))


class TesseraError(Exception):
    """``path`` and ``reason`` say what failed validation; they never hold document text."""

    def __init__(self, code: str, message: str = "", path: str | None = None, reason: str | None = None):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.path, self.reason = code, path, reason
        self.category, self.status = _BY_CODE.get(code, ("internal", 500))
        self.retryable = code in RETRYABLE


def http_code(status: int) -> str:
    """The code for a model service's HTTP status."""
    if status in (401, 403):
        return "AUTHENTICATION"
    if status == 429:
        return "RATE_LIMITED"
    return "TIMEOUT" if status in (408, 504) else "INVALID_RESPONSE"
