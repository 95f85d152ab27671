
from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

# Defaults.
DEFAULTS = {
    "parser": {"poll_interval": 3, "log_poll_interval": 3, "progress_threshold": 10, "poll_timeout": 0, "max_pages": 200, "max_size_mb": 200, "concurrency": 5, "download_timeout": 120},
    "model": {"request_body": {}, "timeout": 400, "connect_timeout": 60, "concurrency": 10, "temperature": 0.1},
    "options": {"max_retries": 3, "api_max_retries": 3, "rate_limit_retries": 100, "window_up": 30, "window_down": 30, "max_window_up": 200, "max_window_down": 200, "format_fix_attempts": 1, "output_language": "Chinese"},
    "paths": {"input": "input", "split": "split", "parsed": "parsed", "markdown": "markdown", "images": "images", "output": "output", "progress": "progress_items", "logs": "logs"},
}


@dataclass
class Config:
    parser: dict[str, Any] = field(default_factory=dict)
    model: dict[str, Any] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)
    paths: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, given: dict[str, dict[str, Any] | None] | None = None) -> Config:
        given = given or {}
        return cls(**{f.name: DEFAULTS[f.name] | {k: v for k, v in (given.get(f.name) or {}).items() if v is not None} for f in fields(cls)})

    @classmethod
    def load(cls, text: str) -> Config:
        """From YAML, or JSON where no YAML library is installed."""
        try:
            import yaml
        except ImportError:
            import json

            return cls.of(json.loads(text))
        return cls.of(yaml.safe_load(text))

    def template(self) -> str:
        import json

        return json.dumps({f.name: getattr(self, f.name) for f in fields(self)}, indent=2, ensure_ascii=False)


def percentiles(said: str) -> list[int]:
    """On the driver: 1 to 99, in their order, once each."""
    out: list[int] = []
    for x in said.split(","):
        if x.strip().lstrip("+-").isdigit() and 1 <= int(x) <= 99 and int(x) not in out:
            out.append(int(x))
    return out


def seed(said: str | None) -> int:
    """Empty is 42, ``random`` is any, else the number, 42 if it is none."""
    import random

    if said == "random":
        return random.SystemRandom().randrange(1 << 31)
    try:
        return int(said or 42)
    except ValueError:
        return 42
