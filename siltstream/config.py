"""Settings of a mission: a YAML file, overridden by the environment, changed within bounds."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

NAME = "siltstream"


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    max_retries: int = 3
    timeout_seconds: int = 30
    request_delay: float = 1.0
    default_workers: int = 5
    asset_workers: int = 8
    log_level: str = "INFO"
    stats_cache_ttl_seconds: float = 5.0

    def changed(self, workers: int | None = None, request_delay_ms: float | None = None, timeout: int | None = None) -> "Settings":
        """The settings with the changes that are within bounds: 1 to 10 workers, no negative delay, 5 s at least."""
        new = {}
        if workers is not None and 1 <= workers <= 10:
            new["default_workers"] = workers
        if request_delay_ms is not None and request_delay_ms >= 0:
            new["request_delay"] = request_delay_ms / 1000
        if timeout is not None and timeout >= 5:
            new["timeout_seconds"] = timeout
        return replace(self, **new)

    def save(self, path: str | Path) -> None:
        import yaml

        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(yaml.safe_dump(asdict(self), allow_unicode=True))


def config_path(custom: str | Path | None = None) -> Path:
    """The file named, else the first that exists of the user's and the system's, else where the user's would be."""
    if custom:
        return Path(custom)
    home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    places = [home / NAME / "config.yaml", Path.home() / ".config" / NAME / "config.yaml", Path("/etc") / NAME / "config.yaml"]
    return next((p for p in places if p.exists()), places[0])


def load(custom: str | Path | None = None) -> Settings:
    """Settings of the file, if it is there; unknown keys are ignored; the environment has the last word."""
    path, data = config_path(custom), {}
    if path.exists():
        import yaml

        data = yaml.safe_load(path.read_text()) or {}
    known = {f.name for f in fields(Settings)}
    settings = Settings(**{k: v for k, v in data.items() if k in known})
    if "SILTSTREAM_DATA_DIR" in os.environ:
        settings = replace(settings, data_dir=os.environ["SILTSTREAM_DATA_DIR"])
    if "SILTSTREAM_MAX_WORKERS" in os.environ:
        settings = replace(settings, default_workers=int(os.environ["SILTSTREAM_MAX_WORKERS"]))
    return replace(settings, data_dir=os.path.expandvars(os.path.expanduser(str(settings.data_dir))))
