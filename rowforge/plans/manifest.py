"""What a pipeline is, as a dict: its steps, their models and prompts, its fields and settings. Nothing of the rows."""

from __future__ import annotations

import logging
from typing import Any
from urllib.parse import urlparse

from ..errors import redact

log = logging.getLogger("rowforge")
TYPES = {"String": "str", "Date": "str", "Number": "float", "Boolean": "bool", "List[String]": "list", "JSON": "json"}


def provider(model: str, base_url: str | None) -> str:
    """Who serves a model: by the server's host, else by the model's name."""
    if base_url:
        host = (urlparse(base_url).hostname or "").split(".")
        return host[-2] if len(host) > 1 and not host[-1].isdigit() else ".".join(host) or "custom"
    return "anthropic" if model.startswith("claude-") else "google" if model.startswith("gemini-") else "openai"


def build_manifest(pipeline: Any, config: Any, capture: str = "metadata") -> dict[str, Any]:
    steps, fields, seen = [], [], set()
    for name in pipeline.step_names:
        s = pipeline.get_step(name)
        model, system = None, None
        if getattr(s, "model", None) is not None:
            model = {"id": s.model, "provider": provider(s.model, s.base_url), "temperature": s.temperature if s.temperature is not None else config.temperature, "max_tokens": s.max_tokens or config.max_tokens}
            system = redact(s.row_independent_system())
        steps.append({"name": name, "type": type(s).__name__, "model": model, "produces": list(s.fields), "depends_on": list(s.depends_on), "condition": None, "system_prompt": system})
        for f in s.fields:
            if f in seen:  # the first step that gives a field is named
                continue
            seen.add(f)
            spec = getattr(s, "field_specs", {}).get(f)
            kind = "unknown" if spec is None or f.startswith("__") else "enum" if spec.enum else TYPES[spec.type]
            fields.append({"name": f, "type": kind, "enum": spec.enum if spec else None, "description": spec.prompt if spec else None, "step": name, "internal": f.startswith("__")})
    batch = any(getattr(pipeline.get_step(n), "batch", False) for n in pipeline.step_names)
    return {"config": {"max_workers": config.max_workers, "caching": config.enable_caching, "checkpointing": config.enable_checkpointing, "batch": batch, "capture": capture}, "steps": steps, "fields": fields}
