"""Settings from a TOML file, a local file that overrides it, and the environment, which overrides both."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from foldstone.functions import scalars


@dataclass(frozen=True)
class Settings:
    """What a store and its cluster run with. ``hold`` is how long a lease lasts, in milliseconds."""

    replicas: int = 3
    shards: int = 256
    segment_bytes: int = 64 << 20
    compress: bool = False
    hold: int = 60_000

    def __post_init__(self) -> None:
        wrong = [name for name, ok in (("replicas", self.replicas >= 1), ("shards", self.shards >= 1), ("segment_bytes", self.segment_bytes >= 1), ("hold", self.hold > 0)) if not ok]
        if wrong:
            raise ValueError(f"out of range: {', '.join(wrong)}")


def _typed(name: str, kind: str, value: object) -> object:
    if kind == "bool":
        text = str(value).lower()
        if text in ("true", "1", "false", "0"):
            return text in ("true", "1")
    elif name == "hold" and isinstance(value, str) and (ms := scalars.duration_ms(value)) is not None:
        return ms
    else:
        try:
            return int(str(value))
        except ValueError:
            pass
    raise ValueError(f"{name}: {value!r}")


def load(path: str | Path, environ: Mapping[str, str] | None = None, prefix: str = "FOLDSTONE_") -> Settings:
    """The settings of ``path``, of the file beside it that ends in ``.local.toml``, and of variables ``PREFIX_NAME``, the later ones first in rank.

    Files that are not there say nothing. An unknown name, or a value of the wrong kind or out of range, is a ValueError.
    """
    base, found = Path(path), {}
    for file in (base, base.with_suffix(".local.toml")):
        if file.is_file():
            found |= tomllib.loads(file.read_text())
    known = {f.name: f.type for f in fields(Settings)}
    for name, value in (os.environ if environ is None else environ).items():
        if name.startswith(prefix) and name[len(prefix) :].lower() in known:
            found[name[len(prefix) :].lower()] = value
    if unknown := sorted(set(found) - set(known)):
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return Settings(**{name: _typed(name, known[name], value) for name, value in found.items()})
