"""Project configuration: defaults, reading and writing."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from .schema import COVERAGE_GATE, EXCLUDE, INCLUDE, LOW_CONFIDENCE, MAX_ANNOTATIONS, MAX_FILE_BYTES, MAX_FILES, PRECEDENCES, REVIEW_BELOW


@dataclass
class Config:
    """What an index reads and how; unknown keys of a stored file are kept."""

    include: list[str] = field(default_factory=lambda: list(INCLUDE))
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    bridge: bool = True
    precedence: str = PRECEDENCES[0]
    docstring_style: str = "auto"
    review_below: float = REVIEW_BELOW
    low_confidence: float = LOW_CONFIDENCE
    coverage_gate: float = COVERAGE_GATE
    max_file_bytes: int = MAX_FILE_BYTES
    max_files: int = MAX_FILES
    max_annotations: int = MAX_ANNOTATIONS
    domains: dict[str, list[str]] = field(default_factory=dict)
    rest: dict = field(default_factory=dict)


def load(path: str) -> Config:
    """The stored configuration, or the defaults if there is no file."""
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    made = Config()
    limits = stored.get("limits") or {}
    bridge = stored.get("bridge") or {}
    made.include = stored.get("include", made.include)
    made.exclude = stored.get("exclude", made.exclude)
    made.bridge = bridge.get("enabled", made.bridge)
    made.precedence = bridge.get("precedence", made.precedence)
    made.docstring_style = (bridge.get("python") or {}).get("docstring_style", made.docstring_style)
    made.max_file_bytes = limits.get("max_file_size_mb", made.max_file_bytes >> 20) << 20
    made.max_files = limits.get("max_files", made.max_files)
    made.max_annotations = limits.get("max_annotations_per_file", made.max_annotations)
    made.domains = {k: v.get("patterns", []) for k, v in (stored.get("domains") or {}).items()}
    made.rest = stored
    return made


def save(config: Config, path: str) -> None:
    """Stores the settings over what the file held before."""
    held = dict(config.rest)
    held |= {"include": config.include, "exclude": config.exclude}
    held["limits"] = (held.get("limits") or {}) | {"max_file_size_mb": config.max_file_bytes >> 20, "max_files": config.max_files, "max_annotations_per_file": config.max_annotations}
    held["bridge"] = (held.get("bridge") or {}) | {"enabled": config.bridge, "precedence": config.precedence}
    with open(path, "w", encoding="utf-8") as file:
        json.dump(held, file, indent=2)


def as_dict(config: Config) -> dict:
    return asdict(config)
