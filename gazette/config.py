"""Settings. An explicit null means the default."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from typing import Any

CRON = re.compile(r"cron\((?:\S+\s+){5}\S+\)")


@dataclass(frozen=True)
class Scraping:
    sources: list[str] = field(default_factory=list)
    days_back: int = 7
    flaky_patterns: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Selection:
    use_filtering: bool = True
    min_content_length: int = 600
    min_score: float = 0.7
    max_posts: int | None = None
    max_per_source: int | None = None
    max_concurrency: int = 10


@dataclass(frozen=True)
class Issue:
    language: str = "en"
    send_emails: bool = False
    sender: str | None = None
    logos: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.send_emails and not self.sender:
            raise ValueError("sending needs a sender")


@dataclass(frozen=True)
class Config:
    stage: str = "dev"
    schedule: str | None = None
    scraping: Scraping = field(default_factory=Scraping)
    selection: Selection = field(default_factory=Selection)
    issue: Issue = field(default_factory=Issue)

    def __post_init__(self) -> None:
        if self.schedule is not None and not CRON.fullmatch(self.schedule):
            raise ValueError(f"no cron expression: {self.schedule}")


def load(said: dict[str, Any] | str) -> Config:
    """From a mapping or JSON text; unknown keys are errors."""
    said = json.loads(said) if isinstance(said, str) else said
    parts = {"scraping": Scraping, "selection": Selection, "issue": Issue}

    def made(kind: type, values: dict[str, Any]):
        known = {f.name for f in fields(kind)}
        if odd := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(odd)}")
        return kind(**{k: v for k, v in values.items() if v is not None})

    return made(Config, {k: made(parts[k], v) if k in parts and v is not None else v for k, v in said.items()})
