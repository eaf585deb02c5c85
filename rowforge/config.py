"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass

_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass
class EnrichmentConfig:
    """Settings of a run.

    ``max_workers`` bounds the rows in flight of model steps and async functions over all tasks of a run, whose tasks are no more than it
    either; a plain function has a row in flight in each task, and more only as far as max_workers goes round. ``cache_dir`` and
    ``checkpoint_dir`` are folders that all executors share; where they aren't given, they are in spark.checkpoint.dir if
    that is set, else under the user's home. With ``checkpoint_interval`` and checkpointing on, a task stores its model calls' results after so many rows, and
    doesn't repeat those calls if it runs again.
    """

    max_tokens: int = 4000
    temperature: float = 0.2
    max_workers: int = 10
    overwrite_fields: bool = False
    max_retries: int = 3
    retry_base_delay: float = 1.0
    on_error: str = "continue"
    log_level: str = "INFO"
    enable_progress_bar: bool = True
    enable_checkpointing: bool = False
    checkpoint_dir: str = ""
    auto_resume: bool = True
    enable_caching: bool = True
    cache_ttl: int = 3600
    cache_dir: str = ""
    checkpoint_interval: int = 0
    batch_poll_interval: float = 60.0
    batch_timeout: float = 86400.0
    batch_max_requests: int = 50_000

    def __post_init__(self):
        if not 0.0 <= self.temperature <= 2.0:
            raise ValueError(f"temperature is from 0 to 2, not {self.temperature}")
        for name in ("max_tokens", "max_workers", "batch_poll_interval", "batch_timeout", "batch_max_requests"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive, not {getattr(self, name)}")
        for name in ("max_retries", "cache_ttl", "checkpoint_interval", "retry_base_delay"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative, not {getattr(self, name)}")
        if self.on_error not in ("continue", "raise"):
            raise ValueError(f"on_error is 'continue' or 'raise', not {self.on_error!r}")
        if self.log_level.upper() not in _LEVELS:
            raise ValueError(f"log_level is one of {', '.join(_LEVELS)}")

    @classmethod
    def for_development(cls) -> EnrichmentConfig:
        return cls(max_workers=5, log_level="DEBUG")

    @classmethod
    def for_production(cls) -> EnrichmentConfig:
        return cls(max_workers=30, enable_checkpointing=True, checkpoint_interval=100, max_retries=5)

    @classmethod
    def for_server(cls) -> EnrichmentConfig:
        return cls(max_workers=30, enable_progress_bar=False, max_retries=5, log_level="WARNING")

    @classmethod
    def for_batch(cls) -> EnrichmentConfig:
        return cls(enable_checkpointing=True, max_retries=5)
