"""Prompts in two halves: one that is the same for all rows of a step, so providers can cache it, and one for the row."""

from __future__ import annotations

import json
from typing import Any, NamedTuple

from ..types import FieldSpec

TASK = "Fill in the fields for this row and answer with one JSON object."
_ABOUT = {
    "type": "**type**: what kind of value (String, Number, Boolean, Date, List[String] or JSON)",
    "format": "**format**: how the value is to be written",
    "enum": "**enum**: the only values allowed",
    "examples": "**examples**: values of the kind wanted",
    "bad_examples": "**bad_examples**: values of the kind not wanted",
    "default": "**default**: what to answer if nothing can be found out",
}


class Prompt(NamedTuple):
    system: str
    user: str


def used_keys(specs: dict[str, FieldSpec]) -> set[str]:
    out = set()
    for s in specs.values():
        out |= {k for k in ("format", "enum", "examples", "bad_examples") if getattr(s, k) is not None}
        out |= {"type"} if s.type != "String" else set()
        out |= {"default"} if s.has_default else set()
    return out


def system_half(specs: dict[str, FieldSpec], custom: str | None = None, header: str | None = None) -> str:
    if custom is not None:
        head = custom
    else:
        used = used_keys(specs)
        parts = ["# Role\nYou complete rows of a table. Each request shows one row and what earlier steps found; you answer with the fields described below."]
        if header:
            parts.append(f"# Context\n{header}")
        parts.append("\n".join(["# Field Specification Keys", "- **prompt**: what the field should hold", *(f"- {text}" for key, text in _ABOUT.items() if key in used)]))
        rules = ["# Output Rules", "- One JSON object and nothing else.", f"- Its keys are exactly: {', '.join(specs)}", "- Short values that say much."]
        if "enum" in used:
            rules.append("- An enum field takes one of its values, letter for letter.")
        if "format" in used:
            rules.append("- A field with a format follows it.")
        rules.append("- Use the row, the earlier results and what you know; only then give up." if "default" not in used else "- Give the default only when the row, the earlier results and what you know don't help.")
        if "default" not in used:
            rules.append('- Giving up is "Unable to determine" in a String field and null in any other.')
        head = "\n\n".join([*parts, "\n".join(rules)])
    lines = ["<field_specifications>"]
    for name, s in specs.items():
        lines += [f'<field name="{name}">', f"  <prompt>{s.prompt}</prompt>"]
        lines += [f"  <type>{s.type}</type>"] if s.type != "String" else []
        lines += [f"  <format>{s.format}</format>"] if s.format is not None else []
        lines += [f"  <enum>{', '.join(s.enum)}</enum>"] if s.enum is not None else []
        lines += [f"  <example>{x}</example>" for x in s.examples or ()] + [f"  <bad_example>{x}</bad_example>" for x in s.bad_examples or ()]
        lines += [f"  <default>{s.default}</default>"] if s.has_default else []
        lines.append("</field>")
    return f"{head}\n\n" + "\n".join([*lines, "</field_specifications>"])


_as_json = json.JSONEncoder(default=str).encode  # made once, as a row's prompt costs little else


def reminder(names: list[str]) -> str:
    return f"# Reminder\nOnly the JSON object, with the keys: {', '.join(names)}."


def user_half(names: list[str], row: dict[str, Any], prior: dict[str, Any] | None) -> str:
    parts = [f"<row_data>\n{_as_json(row)}\n</row_data>"]
    if prior:
        parts.append(f"<prior_results>\n{_as_json(prior)}\n</prior_results>")
    return "\n\n".join([*parts, TASK, reminder(names)])


def build_prompt(specs: dict[str, FieldSpec], row: dict[str, Any], prior: dict[str, Any] | None = None, custom: str | None = None, header: str | None = None) -> Prompt:
    return Prompt(system_half(specs, custom, header), user_half(list(specs), row, prior))
