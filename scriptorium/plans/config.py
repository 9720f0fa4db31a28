"""Settings from a configuration file, with dotted access; secrets come from the environment only."""

from __future__ import annotations

import json
import os
import re
from dataclasses import fields
from pathlib import Path

from scriptorium.schema import Settings

#: Where each setting stands in a configuration.
_PLACES = {
    "profile": "profile", "auto_add": "thresholds.auto_add", "review": "thresholds.review", "fuzzy": "ranking.title_fuzzy_threshold",
    "high_priority_score": "ranking.high_priority_tag_score", "max_auto_add": "safety.max_auto_add_per_scan", "max_calls": "llm.max_calls_per_run",
    "overlap_days": "scan.overlap_days", "lookback_days": "scan.min_lookback_days", "first_run_years": "scan.first_run_years",
    "normalize_citation_age": "ranking.citation_age_normalization", "prefer_peer_reviewed": "ranking.prefer_peer_reviewed",
    "high_priority_venues": "high_priority_venues", "venue_weights": "venue_weights",
}


def dotted(config: dict, path: str, default=None):
    """A value by its dotted path."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def _scalar(text: str):
    """A YAML scalar or inline list as a value."""
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(part) for part in re.findall(r"""\s*("[^"]*"|'[^']*'|[^,]+)""", text[1:-1]) if part.strip()]
    if text in ("", "~", "null"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _lines(text: str) -> list[tuple[int, str]]:
    """(indent, content) of lines that hold something; comments go, but not in quotes."""
    out = []
    for line in text.splitlines():
        bare = re.match(r"""((?:[^#'"]|'[^']*'|"[^"]*"|(?<=\S)#|(?<=\w)')*)""", line)[0].rstrip()
        if bare.strip() and bare.strip() != "---":
            out.append((len(bare) - len(bare.lstrip()), bare.strip()))
    return out


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    """(value, next line) of the mapping or list that begins at a line."""
    listed = lines[at][1].startswith("-")
    out: list | dict = [] if listed else {}
    while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-") == listed:
        said = lines[at][1]
        if listed:
            said = said[1:].strip()
            if re.match(r"[\w.-]+:(\s|$)", said):  # a mapping whose first entry stands behind the hyphen
                inner = indent + lines[at][1].index(said)
                lines[at] = (inner, said)
                value, at = _block(lines, at, inner)
                out.append(value)
                continue
            out.append(_scalar(said))
            at += 1
            continue
        name, _, rest = said.partition(":")
        at += 1
        if rest.strip():
            out[_scalar(name)] = _scalar(rest)
        elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-"))):
            out[_scalar(name)], at = _block(lines, at, lines[at][0])
        else:
            out[_scalar(name)] = None
    return out, at


def read_yaml(text: str):
    """The YAML that configurations are written in: nested mappings and lists in blocks, inline lists, scalars, comments."""
    lines = _lines(text)
    if not lines:
        return {}
    value, at = _block(lines, 0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"can't read the configuration from {lines[at][1]!r} on")
    return value


def load_config(path: str | Path) -> dict:
    """A configuration from JSON or YAML."""
    text = Path(path).read_text()
    return (read_yaml(text) if str(path).endswith((".yaml", ".yml")) else json.loads(text)) or {}


def settings_of(config: dict, authors: list[dict] | None = None) -> Settings:
    """Settings with what a configuration says, defaults elsewhere."""
    known = {f.name for f in fields(Settings)}
    given = {name: value for name, place in _PLACES.items() if name in known and (value := dotted(config, place)) is not None}
    if "high_priority_venues" in given:
        given["high_priority_venues"] = tuple(given["high_priority_venues"])
    return Settings(**given, authors=tuple(authors or ()))


def secret(name: str) -> str | None:
    """A credential from the environment, empty ones as missing."""
    return (os.environ.get(name) or "").strip() or None
