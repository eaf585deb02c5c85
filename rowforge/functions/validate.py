"""Checking of model replies against field specifications, and the JSON schema that describes them.

Numbers given as text and booleans given as words or 0 and 1 are taken, as models write them; anything else must have its type.
"""

from __future__ import annotations

import json
import re
from typing import Any

from ..types import FieldSpec
from .text import REFUSALS

_TRUE, _FALSE = {"true", "t", "yes", "y", "on", "1"}, {"false", "f", "no", "n", "off", "0"}
_WORDS = _TRUE | _FALSE
_NUMBER = re.compile(r"\s*[+-]?(\d+(_\d+)*\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|nan)\s*", re.I)


class ValidationError(ValueError):
    """A reply that doesn't fit its fields."""


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces; what JSON lacks becomes text."""
    return _canonical(value)


_canonical = json.JSONEncoder(sort_keys=True, separators=(",", ":"), default=str).encode


def coerce(name: str, value: Any, spec: FieldSpec) -> Any:
    no = lambda what: ValidationError(f"{name}: {what}, not {value!r}")
    if spec.enum:
        if value not in spec.enum or not isinstance(value, str):
            raise no(f"one of {', '.join(spec.enum)}")
        return value
    if spec.type in ("String", "Date"):
        if not isinstance(value, str):
            raise no("a string")
        return value
    if spec.type == "Number":
        if isinstance(value, (bool, int, float)):
            return float(value)
        if isinstance(value, str) and _NUMBER.fullmatch(value):
            return float(value)
        raise no("a number")
    if spec.type == "Boolean":
        if isinstance(value, bool):
            return value
        if isinstance(value, (int, float)) and value in (0, 1):
            return bool(value)
        if isinstance(value, str) and value.lower() in _WORDS:
            return value.lower() in _TRUE
        raise no("a boolean")
    if spec.type == "List[String]":
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise no("a list of strings")
        return value
    if not isinstance(value, dict):
        raise no("an object")
    return value


def check(parsed: dict[str, Any], specs: dict[str, FieldSpec]) -> dict[str, Any]:
    """The fields' values; a missing field, an unknown key and a wrong type are errors. Internal fields (__) are not checked."""
    own = {k: v for k, v in specs.items() if not k.startswith("__")}
    problems = [f"{k}: missing" for k in own if k not in parsed] + [f"{k}: not asked for" for k in parsed if k not in own]
    out = {}
    for k, spec in own.items():
        if k in parsed:
            try:
                out[k] = coerce(k, parsed[k], spec)
            except ValidationError as e:
                problems.append(str(e))
    if problems:
        raise ValidationError("; ".join(problems))
    return out


def strip_fences(content: str) -> str:
    """The body of a reply that is wrapped in a Markdown code fence."""
    if not content.strip().startswith("```"):
        return content
    lines = content.strip().split("\n")[1:]
    return "\n".join(lines[:-1] if lines and lines[-1].strip() == "```" else lines)


def is_refusal(value: Any) -> bool:
    return value is None or isinstance(value, str) and value.strip().lower() in ("", *REFUSALS)


def with_defaults(values: dict[str, Any], specs: dict[str, FieldSpec]) -> dict[str, Any]:
    """Refusals replaced by the field's default, where it has one, unless the value is a member of the field's enum."""
    for name, spec in specs.items():
        v = values.get(name, 0)
        if name in values and spec.has_default and is_refusal(v) and not (spec.enum and isinstance(v, str) and v.strip().lower() in {e.lower() for e in spec.enum}):
            values[name] = spec.default
    return values


_JSON_TYPES: dict[str, dict[str, Any]] = {
    "String": {"type": "string"}, "Date": {"type": "string"}, "Number": {"type": "number"}, "Boolean": {"type": "boolean"},
    "List[String]": {"type": "array", "items": {"type": "string"}}, "JSON": {"type": "object", "additionalProperties": True},
}


def json_schema(specs: dict[str, FieldSpec]) -> dict[str, Any]:
    """The response_format that makes a provider hold to the fields."""
    props = {}
    for name, s in specs.items():
        if name.startswith("__"):
            continue
        kind = {"type": "string", "enum": list(s.enum)} if s.enum else dict(_JSON_TYPES[s.type])
        about = [s.prompt, *([f"Format: {s.format}"] if s.format is not None else []), *([f"Examples: {'; '.join(s.examples)}"] if s.examples is not None else [])]
        props[name] = kind | {"description": ". ".join(about)}
    schema = {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}
    return {"type": "json_schema", "json_schema": {"name": "fields", "schema": schema, "strict": True}}
