"""Settings of runs and of the model that answers, from the session's configuration, the environment or a file of KEY=VALUE lines."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from quarryline.operators.evidence import MOST_CHARS, MOST_LINES

#: Settings that are never shown.
SECRET = ("github_token", "model_api_key")


@dataclass(frozen=True)
class Settings:
    github_token: str | None = None
    model_api_key: str | None = None
    run_store: str = "data/agent-runs"
    model_output_tokens: int = 20_000
    model_timeout_seconds: float = 180.0
    model_temperature: float = 0.1
    evidence_chars: int = MOST_CHARS
    evidence_lines: int = MOST_LINES

    def __post_init__(self) -> None:
        if not 0 <= self.model_temperature <= 2:
            raise ValueError("model_temperature must be between 0 and 2")
        for name in ("model_output_tokens", "evidence_chars", "evidence_lines"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def __repr__(self) -> str:
        shown = {f.name: "***" if f.name in SECRET and getattr(self, f.name) else getattr(self, f.name) for f in fields(self)}
        return f"Settings({', '.join(f'{k}={v!r}' for k, v in shown.items())})"


def read_settings(spark: SparkSession | None = None, file: str = ".env") -> Settings:
    """Each setting from spark.quarryline.<name> of the session, else from the environment (its name in capitals), else from the file, else its default. Other names there are ignored."""
    lines = {}
    if os.path.exists(file):
        with open(file, encoding="utf-8") as text:
            for line in text:
                key, sign, value = line.strip().removeprefix("export ").partition("=")
                if sign and not key.startswith("#"):
                    lines[key.strip().lower()] = value.strip().strip("\"'")
    given = {}
    for f in fields(Settings):
        value = spark.conf.get(f"spark.quarryline.{f.name}", None) if spark else None
        value = value if value is not None else os.environ.get(f.name.upper(), lines.get(f.name))
        if value is not None:
            given[f.name] = type(f.default)(value) if isinstance(f.default, (int, float)) else value
    return Settings(**given)
