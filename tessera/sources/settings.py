"""Settings from the environment and a ``.env`` file; the environment wins."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

TRACKERS = ("json", "mlflow", "none")


class ConfigError(ValueError):
    pass


def load_dotenv(path: str | Path) -> dict[str, str]:
    """``KEY=VALUE`` lines; comments and lines without ``=`` are skipped, quotes around a value go."""
    path, out = Path(path), {}
    if path.is_file():
        for line in path.read_text(encoding="utf-8").splitlines():
            key, equals, value = line.strip().partition("=")
            if equals and not key.startswith("#"):
                out[key.strip()] = value.strip().strip("\"'")
    return out


@dataclass(frozen=True)
class Settings:
    data_dir: Path = Path("data")
    work_dir: Path = Path("artifacts")
    seed: int = 42
    image_size: int = 128
    batch_size: int = 32
    tracker: str = "json"
    experiment: str = "tessera"
    device: str = "cpu"
    mlflow_uri: str | None = None

    splits_dir = property(lambda self: self.work_dir / "splits")
    cache_dir = property(lambda self: self.work_dir / "features")
    models_dir = property(lambda self: self.work_dir / "models")
    runs_dir = property(lambda self: self.work_dir / "runs")

    @classmethod
    def from_env(cls, env=None, dotenv: str | Path | None = ".env") -> Settings:
        found = (load_dotenv(dotenv) if dotenv is not None else {}) | dict(os.environ if env is None else env)
        text = {k: found.get(f"TESSERA_{k.upper()}") for k in ("data_dir", "work_dir", "tracker", "experiment", "device")}
        out = {k: Path(v) if k.endswith("_dir") else v for k, v in text.items() if v}
        for key, least in (("seed", 0), ("image_size", 32), ("batch_size", 1)):
            if raw := found.get(f"TESSERA_{key.upper()}"):
                try:
                    out[key] = int(raw)
                except ValueError:
                    raise ConfigError(f"TESSERA_{key.upper()} is a whole number, not {raw!r}") from None
                if out[key] < least:
                    raise ConfigError(f"TESSERA_{key.upper()} is {least} at least, not {raw}")
        out["tracker"] = out.get("tracker", "json").lower()
        if out["tracker"] not in TRACKERS:
            raise ConfigError(f"TESSERA_TRACKER is one of {TRACKERS}, not {out['tracker']!r}")
        return cls(**out, mlflow_uri=found.get("MLFLOW_TRACKING_URI") or None)
