"""Settings from the environment or an env file, as one frozen record."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    newsapi_key: str = ""
    request_timeout: int = 30
    max_retries: int = 3
    retry_backoff: float = 2.0
    rate_limit_delay: float = 1.0
    max_workers: int = 5
    search_max_results: int = 50
    search_region: str = "wt-wt"
    search_safesearch: str = "moderate"
    raw_data_dir: Path = Path("data/raw")
    cleaned_data_dir: Path = Path("data/cleaned")
    failed_data_dir: Path = Path("data/failed")
    exports_dir: Path = Path("data/exports")
    log_dir: Path = Path("logs")
    log_level: str = "INFO"

    def with_dirs(self) -> Settings:
        """Make the local folders that are missing."""
        for f in fields(self):
            if isinstance(value := getattr(self, f.name), Path):
                value.mkdir(parents=True, exist_ok=True)
        return self


def load(env_file: str | None = None, base: str | Path = ".", environ: dict[str, str] | None = None) -> Settings:
    """Settings by upper-case names; the environment wins over the file, relative paths start at `base`."""
    found: dict[str, str] = {}
    if env_file and Path(env_file).is_file():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.partition("=")
            if eq and not key.lstrip().startswith("#"):
                found[key.strip().upper()] = value.strip().strip("'\"")
    found |= {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
    values = {}
    for f in fields(Settings):
        raw = found.get(f.name.upper())
        kind = type(f.default)
        value = f.default if raw is None else kind(raw)
        values[f.name] = Path(base, value).absolute() if isinstance(value, Path) else value
    return Settings(**values)
