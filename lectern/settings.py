"""Settings of a service that runs the analysis, from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

_TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    """Defaults hold where a variable is missing; an empty feature version means the one of the package."""

    environment: str = "development"
    feature_version: str | None = None
    model_version: str = "0.1.0"
    rate_limit_per_minute: int = 60
    passage_window: int = 3
    passage_stride: int = 1
    paragraph_fallback: bool = True

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls(
            environment=env.get("ENVIRONMENT", cls.environment),
            feature_version=env.get("FEATURE_VERSION") or None,
            model_version=env.get("MODEL_VERSION", cls.model_version),
            rate_limit_per_minute=int(env.get("RATE_LIMIT_PER_MINUTE", cls.rate_limit_per_minute)),
            passage_window=int(env.get("PASSAGE_WINDOW", cls.passage_window)),
            passage_stride=int(env.get("PASSAGE_STRIDE", cls.passage_stride)),
            paragraph_fallback=env.get("PARAGRAPH_FALLBACK", "true").lower() in _TRUE,
        )
