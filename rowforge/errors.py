"""Errors, the row-error record, and the redaction of secrets in messages."""

from __future__ import annotations

import re
from dataclasses import dataclass

REDACTED = "***REDACTED***"
#: Applied in this order; Spark's regexp_replace takes the same patterns (functions.text.redact).
SECRETS = (
    r"sk-[A-Za-z0-9_-]{20,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"(?i)\bbearer\s+[A-Za-z0-9._-]+",
    r"(?i)authorization\s*:\s*\S+",
    r"(?i)api[_-]?key\s*[:=]\s*\S+",
)
_SECRETS = [re.compile(p) for p in SECRETS]


def redact(text: str) -> str:
    for p in _SECRETS:
        text = p.sub(REDACTED, text)
    return text


class EnrichmentError(Exception):
    """Base of the library's errors."""


class ConfigurationError(EnrichmentError, ValueError):
    """A setting that can't work."""


class FieldValidationError(EnrichmentError, ValueError):
    """A field specification that can't be used."""


class PipelineError(EnrichmentError):
    """A pipeline that can't be built or run."""


class StepError(EnrichmentError):
    def __init__(self, message: str, step_name: str | None = None):
        super().__init__(message)
        self.step_name = step_name


class LLMAPIError(EnrichmentError):
    """A failed model call; 408, 429 and 5xx can be tried again unless ``retryable`` says otherwise."""

    def __init__(self, message: str, status_code: int | None = None, retry_after: float | None = None, is_rate_limit: bool = False, retryable: bool | None = None):
        super().__init__(redact(message))
        self.status_code, self.retry_after, self.is_rate_limit = status_code, retry_after, is_rate_limit or status_code == 429
        self.retryable = (self.is_rate_limit or status_code == 408 or (status_code or 0) >= 500) if retryable is None else retryable

    @property
    def status(self) -> str:
        return "rate_limited" if self.is_rate_limit else "timeout" if self.status_code == 408 else "api_error"


@dataclass(frozen=True)
class RowError:
    row_index: int
    step_name: str
    error: str
    error_type: str
