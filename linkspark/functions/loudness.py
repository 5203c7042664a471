"""Loudness: album values from track values, gain texts, and measurement of sample streams (ITU-R BS.1770)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reference level of replay gain in LUFS; absolute gate; relative gate in LU.
REFERENCE_LUFS, ABSOLUTE_GATE, RELATIVE_GATE = -18.0, -70.0, -10.0


def energy_to_loudness(energy: Column) -> Column:
    return 10 * F.log10(energy) - 0.691


def replay_gain(lufs: Column) -> Column:
    return F.lit(REFERENCE_LUFS) - lufs


def db_to_ratio(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def ratio_to_db(ratio: Column) -> Column:
    return 20 * F.log10(ratio)


def channel_peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x)))


def quantise(samples: Column) -> Column:
    """Samples as whole numbers of 16 bits, cut off and saturated."""
    return F.transform(samples, lambda x: F.least(F.greatest((x.cast("double") * 32768).cast("bigint"), F.lit(-32768)), F.lit(32767)).cast("int"))


def album_aggregates(peak: Column, blocks: Column, energy: Column) -> list[Column]:
    """Aggregate columns album_lufs, album_peak, album_blocks; all null unless every row has a measurement."""
    whole = (F.count(peak) == F.count(F.lit(1))) & (F.count(blocks) == F.count(F.lit(1))) & (F.count(energy) == F.count(F.lit(1))) & (F.sum(blocks) > 0)
    return [
        F.when(whole, energy_to_loudness(F.sum(energy) / F.sum(blocks))).alias("album_lufs"),
        F.when(whole, F.max(peak)).alias("album_peak"),
        F.when(whole, F.sum(blocks)).alias("album_blocks"),
    ]


@F.pandas_udf(T.StringType())
def exact_decimal(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Decimal text of the exact binary value, ties to even, as Spark's own formatting does not give it."""
    return pd.Series([None if pd.isna(v) else f"{v:.{int(d)}f}" for v, d in zip(value, digits)])


def gain_text(lufs: Column) -> Column:
    return F.concat(exact_decimal(replay_gain(lufs), F.lit(2)), F.lit(" dB"))


def peak_text(peak: Column) -> Column:
    return exact_decimal(peak, F.lit(6))


def _k_weighted(x: np.ndarray, rate: int) -> np.ndarray:
    """Both filters of the K weighting, their coefficients computed for the sample rate."""

    def biquad(x: np.ndarray, b: tuple, a: tuple) -> np.ndarray:
        y = np.zeros_like(x)
        x1 = x2 = y1 = y2 = 0.0
        for i, v in enumerate(x):
            y[i] = w = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
            x2, x1, y2, y1 = x1, v, y1, w
        return y

    f0, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k = np.tan(np.pi * f0 / rate)
    vh = 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    x = biquad(x, ((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0), (2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0))
    f0, q = 38.13547087602444, 0.5003270373238773
    k = np.tan(np.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    return biquad(x, (1.0, -2.0, 1.0), (2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0))


def measure(samples: np.ndarray, rate: int) -> tuple[float | None, float, int, float]:
    """(LUFS, peak, gated blocks, their energy) of one channel; no LUFS if every block is below the absolute gate."""
    x = np.asarray(samples, dtype=np.float64)
    peak = float(np.abs(x).max()) if len(x) else 0.0
    size, step = int(0.4 * rate), int(0.1 * rate)
    if size < 1 or len(x) < size:
        return None, peak, 0, 0.0
    squares = np.concatenate([[0.0], np.cumsum(_k_weighted(x, rate) ** 2)])
    at = np.arange(0, len(x) - size + 1, max(step, 1))
    z = (squares[at + size] - squares[at]) / size
    with np.errstate(divide="ignore"):
        loud = 10 * np.log10(z) - 0.691
    z = z[loud >= ABSOLUTE_GATE]
    if not len(z):
        return None, peak, 0, 0.0
    relative = 10 * np.log10(z.mean()) - 0.691 + RELATIVE_GATE
    kept = z[10 * np.log10(z) - 0.691 >= relative]
    return float(10 * np.log10(kept.mean()) - 0.691), peak, len(kept), float(kept.sum())
