"""Settings: defaults, overridden by TOML files in order, unknown keys refused."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path

from linkspark.functions.template import ALBUM_FORMAT, COMPILATION_FORMAT


@dataclass(frozen=True)
class TrackWeights:
    """Default weights of the attributes of a track."""

    track_title: float = 3.0
    track_artist: float = 3.0
    track_number: float = 1.0
    track_length: float = 1.0
    musicbrainz_recording_id: float = 5.0


@dataclass(frozen=True)
class ReleaseWeights:
    """Default weights of the attributes of a release; the assignment counts by its number of tracks."""

    release_title: float = 3.0
    release_artist: float = 3.0
    musicbrainz_release_id: float = 5.0
    media_format: float = 1.0
    record_label: float = 0.5
    catalog_number: float = 0.5
    barcode: float = 0.5
    track_assignment: float = 1.0


@dataclass(frozen=True)
class Weights:
    track: TrackWeights = field(default_factory=TrackWeights)
    release: ReleaseWeights = field(default_factory=ReleaseWeights)


@dataclass(frozen=True)
class Lookup:
    release_candidate_limit: int = 5
    connection_limit: int = 10


@dataclass(frozen=True)
class Paths:
    library: str = "~/Music"
    album_format: str = ALBUM_FORMAT
    compilation_format: str = COMPILATION_FORMAT


@dataclass(frozen=True)
class Analyzers:
    """Parallel jobs, 0 for one a core, and the analyzers that run, in order."""

    num_parallel_jobs: int = 0
    enabled: list[str] = field(default_factory=lambda: ["track_length", "chromaprint_fingerprint", "ebu_r128"])


@dataclass(frozen=True)
class Config:
    weights: Weights = field(default_factory=Weights)
    lookup: Lookup = field(default_factory=Lookup)
    paths: Paths = field(default_factory=Paths)
    analyzers: Analyzers = field(default_factory=Analyzers)
    auto_select_distance: float = 0.05

    def __post_init__(self) -> None:
        for part in (self.weights.track, self.weights.release):
            for f in fields(part):
                value = getattr(part, f.name)
                if not (0 <= value < float("inf")):
                    raise ValueError(f"weight {f.name} must be finite and not negative: {value}")


def merged(base, overrides: dict):
    """``base`` with the nested ``overrides``; a key that it lacks or a value of another kind is an error."""
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    changed = {}
    for key, value in overrides.items():
        if key not in known:
            raise KeyError(f"unknown setting: {key}")
        old = known[key]
        if is_dataclass(old):
            if not isinstance(value, dict):
                raise TypeError(f"setting {key} must be a table")
            changed[key] = merged(old, value)
        else:
            if isinstance(value, bool) or not isinstance(value, (type(old), int) if isinstance(old, float) else type(old)):
                raise TypeError(f"setting {key} must be {type(old).__name__}")
            changed[key] = type(old)(value)
    return replace(base, **changed)


def load(*paths: str | Path) -> Config:
    """Defaults overridden by each existing file in turn; a named file that can't be read or parsed is an error."""
    config = Config()
    for path in paths:
        with open(path, "rb") as f:
            config = merged(config, tomllib.load(f))
    return config
