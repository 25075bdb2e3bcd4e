"""Settings of a deployment, read from text such as environment variables."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass


def _leading(value: str | None) -> int | None:
    """The whole number that a text begins with."""
    found = re.match(r"\s*([+-]?\d+)", value or "")
    return int(found[1]) if found else None


def positive(value: str | None, default: int) -> int:
    n = _leading(value)
    return n if n is not None and n > 0 else default


def not_negative(value: str | None, default: int) -> int:
    n = _leading(value)
    return n if n is not None and n >= 0 else default


@dataclass(frozen=True)
class Settings:
    page_size: int = 1000
    lookahead_days: int = 90
    images_enabled: bool = False
    image_ttl_hours: int = 6
    image_cache_mb: int = 512
    image_refresh_hours: int = 24
    image_max_bytes: int = 10 << 20
    retention_days: int = 0
    inactive_days: int = 7
    language: str = "ca"

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Settings:
        """Whatever is missing or no such number keeps its default."""
        numbers = {n: positive(env.get(n.upper()), getattr(cls, n)) for n in ("page_size", "lookahead_days", "image_ttl_hours", "image_cache_mb", "image_refresh_hours", "image_max_bytes", "inactive_days")}
        return cls(**numbers, retention_days=not_negative(env.get("RETENTION_DAYS"), cls.retention_days), images_enabled=env.get("IMAGES_ENABLED") == "true", language=env.get("LANGUAGE") or cls.language)
