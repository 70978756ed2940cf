"""Configuration from TOML: document types, tags, projects, models."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

STATUSES = ("canonical", "provisional", "archived", "missing")
STRATEGIES = ("none", "positional", "timestamped")
PARSER_NAMES = ("whole", "markdown", "copilot_email", "chat", "email", "whisper")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class DocType:
    name: str
    source_pattern: str | None = None
    extension: str | None = None
    parser: str = "whole"
    merge_strategy: str = "none"
    preprocessor: str | None = None
    skip: bool = False
    extract: bool = True
    cleanup_patterns: tuple[str, ...] = ()
    merge_consecutive_same_author: bool = False
    prompt: str | None = None

    def __post_init__(self):
        if self.parser not in PARSER_NAMES or self.merge_strategy not in STRATEGIES:
            raise ConfigError(f"document type {self.name}: parser {self.parser}, strategy {self.merge_strategy}")
        if self.source_pattern:
            re.compile(self.source_pattern)


# The built-in document types and default exclusions.
BUILT_IN = (
    DocType("copilot_email", "Copilot", parser="copilot_email", merge_strategy="positional"),
    DocType("email", "- (Outlook|Mail|Gmail)( - Brave)?$", merge_strategy="positional"),
    DocType("slack", "(Channel|DM).*Slack( - Brave)?$", merge_strategy="positional"),
    DocType("meeting_transcript", "(Zoom|Teams Meeting|Google Meet)", skip=True),
    DocType("claude", "Claude( - Brave)?$", parser="markdown"),
    DocType("markdown", extension="md", parser="markdown"),
)
DEFAULT_EXCLUDE = ("junk", "archived", "superseded")


def load_doctypes(path: str | None = None) -> tuple[DocType, ...]:
    """Types of a file, in its order; the built-in ones without a file."""
    if path is None or not Path(path).exists():
        return BUILT_IN
    known = {f for f in DocType.__dataclass_fields__}
    rows = tomllib.loads(Path(path).read_text()).get("doctype", [])
    return tuple(DocType(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if k in known}) for row in rows)


def no_extract(types: tuple[DocType, ...]) -> list[str]:
    return [t.name for t in types if not t.extract]


@dataclass(frozen=True)
class Tags:
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE
    includes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    colors: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, *paths: str) -> Tags:
        """From the first path that exists; built-in values without one."""
        for path in paths:
            if Path(path).exists():
                raw = tomllib.loads(Path(path).read_text())
                return cls(tuple(raw.get("defaults", {}).get("exclude", ())), {k: tuple(v) for k, v in raw.get("includes", {}).items()}, dict(raw.get("colors", {})))
        return cls()

    def expand(self, tags: list[str]) -> list[str]:
        """Tags and their direct children, each once, in order."""
        return list(dict.fromkeys(t for tag in tags for t in (tag, *self.includes.get(tag, ()))))

    def hidden(self, explicit: list[str] | None = None, include_all: bool = False) -> list[str]:
        return [] if include_all else self.expand(list(explicit if explicit is not None else self.exclude))


@dataclass(frozen=True)
class Rule:
    glob: str
    status: str
    role: str | None = None

    @property
    def pattern(self) -> str:
        """Anchored regular expression: a star or question mark never crosses a slash."""
        special = {"*": "[^/]*", "?": "[^/]"}
        return "^" + "".join(special.get(c) or re.escape(c) for c in self.glob) + "$"


@dataclass(frozen=True)
class Project:
    name: str
    root: str
    rules: tuple[Rule, ...]


def load_manifest(path: str) -> tuple[Rule, ...]:
    rules = tuple(Rule(r["glob"], r["status"], r.get("role")) for r in tomllib.loads(Path(path).read_text()).get("docs", []))
    for rule in rules:
        if rule.status not in STATUSES:
            raise ConfigError(f"{path}: unknown status {rule.status}")
    return rules


def load_projects(registry: str, only: str | None = None) -> list[Project]:
    """All registered projects, or the named one; an unknown name is an error. A root defaults to the manifest's folder."""
    rows = tomllib.loads(Path(registry).read_text()).get("project", [])
    found = [Project(r["name"], r.get("root") or str(Path(r["manifest"]).expanduser().parent), load_manifest(str(Path(r["manifest"]).expanduser()))) for r in rows if only in (None, r["name"])]
    if only and not found:
        raise ConfigError(f"no project is named {only}")
    return found


@dataclass(frozen=True)
class Models:
    """Backends and models per task, the instructions for each length, and framings by document type."""

    backend: str = "offline"
    url: str = "http://localhost:11434"
    tasks: dict[str, str] = field(default_factory=dict)
    detailed: dict[str, str] = field(default_factory=dict)
    brief: str = "Summarise in one or two sentences."
    rules: str = "List each claim of the text on a line of its own."
    framings: dict[str, str] = field(default_factory=dict)
    short_bytes: int = 1200
    medium_bytes: int = 3500

    @classmethod
    def load(cls, path: str) -> Models:
        if not Path(path).exists():
            return cls()
        raw = tomllib.loads(Path(path).read_text())
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        return cls(**known)

    def model(self, task: str) -> str:
        return self.tasks.get(task) or self.tasks.get("default", "none")

    def instructions(self, tier: str) -> str:
        return self.detailed.get(tier) or self.detailed.get("default", "Summarise the document in detail.")

    def framing(self, doctype: str | None) -> str | None:
        return self.framings.get(doctype or "") or self.framings.get("default")
