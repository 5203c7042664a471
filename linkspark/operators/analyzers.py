"""Plug-in analyzers of sample streams: initialised, fed blocks, ended early when complete, and finalised.

All enabled analyzers run in one pass over a track. A failing one gives its error, the others go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.functions import fingerprint, loudness

#: Samples of a block that analyzers are fed.
BLOCK = 4096


class Analyzer:
    """Life cycle of an analyzer of one track."""

    def __init__(self, rate: int, n_samples: int):
        self.rate, self.n_samples = rate, n_samples

    def feed(self, samples: np.ndarray) -> None:
        raise NotImplementedError

    @property
    def complete(self) -> bool:
        return False

    def finalize(self) -> dict:
        raise NotImplementedError


class TrackLength(Analyzer):
    """Length from the metadata alone."""

    @property
    def complete(self) -> bool:
        return True

    def feed(self, samples: np.ndarray) -> None: ...

    def finalize(self) -> dict:
        if self.rate <= 0:
            raise ValueError("no sample rate")
        return {"length_ms": self.n_samples * 1000 // self.rate}


class Fingerprint(Analyzer):
    """Fingerprint of the first seconds."""

    def __init__(self, rate: int, n_samples: int):
        super().__init__(rate, n_samples)
        self.kept: list[np.ndarray] = []
        self.missing = fingerprint.LISTEN_S * rate

    @property
    def complete(self) -> bool:
        return self.missing <= 0

    def feed(self, samples: np.ndarray) -> None:
        self.kept.append(samples[: self.missing])
        self.missing -= len(samples)

    def finalize(self) -> dict:
        return {"fingerprint": fingerprint.packed(fingerprint.words(np.concatenate(self.kept) if self.kept else np.zeros(0), self.rate))}


class Loudness(Analyzer):
    def __init__(self, rate: int, n_samples: int):
        super().__init__(rate, n_samples)
        self.kept: list[np.ndarray] = []

    def feed(self, samples: np.ndarray) -> None:
        self.kept.append(samples)

    def finalize(self) -> dict:
        lufs, peak, blocks, energy = loudness.measure(np.concatenate(self.kept) if self.kept else np.zeros(0), self.rate)
        return {"lufs": lufs, "peak": peak, "blocks": blocks, "energy": energy}


ANALYZERS: dict[str, type[Analyzer]] = {"track_length": TrackLength, "chromaprint_fingerprint": Fingerprint, "ebu_r128": Loudness}
RESULT = "length_ms long, fingerprint binary, lufs double, peak double, blocks long, energy double, errors map<string,string>"


def run(samples: np.ndarray, rate: int, enabled: list[str]) -> dict:
    """Results of all enabled analyzers over one track, errors by analyzer."""
    out: dict = {"errors": {}}
    active: dict[str, Analyzer] = {}

    def guarded(name: str, fn):
        try:
            return fn()
        except Exception as e:  # noqa: BLE001 - an analyzer may fail in any way
            out["errors"][name] = str(e) or type(e).__name__
            active.pop(name, None)
            return None

    for name in enabled:
        made = guarded(name, lambda n=name: ANALYZERS[n](rate, len(samples)))
        if made is not None:
            active[name] = made
    at = 0
    while at < len(samples) and any(not a.complete for a in active.values()):
        block = samples[at : at + BLOCK]
        for name, a in list(active.items()):
            if not a.complete:
                guarded(name, lambda a=a: a.feed(block))
        at += BLOCK
    for name, a in list(active.items()):
        out.update(guarded(name, a.finalize) or {})
    return out


def analyze(tracks: DataFrame, id_col: str, samples: str, rate: str, enabled: list[str] | None = None) -> DataFrame:
    """id and the results of the analyzers; null samples count as an empty track."""
    names = list(enabled or ANALYZERS)
    kind = tracks.schema[id_col].dataType.simpleString()

    def batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["length_ms", "fingerprint", "lufs", "peak", "blocks", "energy", "errors"]
        for b in batches:
            rows = []
            for i, s, r in zip(b["id"], b["samples"], b["rate"]):
                res = run(np.zeros(0) if s is None else np.asarray(s, dtype=np.float64), int(r), names)
                rows.append([i, *[res.get(c) for c in columns]])
            out = pd.DataFrame(rows, columns=["id", *columns], dtype=object)
            for c in ("length_ms", "blocks"):
                out[c] = out[c].astype("Int64")
            for c in ("lufs", "peak", "energy"):
                out[c] = pd.to_numeric(out[c])
            yield out

    return tracks.select(F.col(id_col).alias("id"), F.col(samples).alias("samples"), F.col(rate).alias("rate")).mapInPandas(batch, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)
