"""Five-axis radar scores of a handcrafted vector (inventory E21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundalike.functions import layout as L
from soundalike.functions.vectors import ColumnOrName, col

AXES = ("timbre", "harmony", "rhythm", "brightness", "intensity")


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def radar_scores(v: ColumnOrName, decimals: int = 3) -> dict[str, Column]:
    """One column per axis; all zero where the vector is too short."""
    vec = col(v)

    def at(i: int) -> Column:
        return F.get(vec, F.lit(i))

    n_mfcc, n_chroma = len(L.MFCC_MEAN) - 1, len(L.CHROMA)
    energy = F.aggregate(F.slice(vec, 2, n_mfcc), F.lit(0.0), lambda s, x: s + x * x)
    chroma = F.aggregate(
        F.slice(vec, L.CHROMA.start + 1, n_chroma), F.lit(0.0), lambda s, x: s + F.abs(x))
    tempo = F.when(at(L.BPM) > 0, _clamped((at(L.BPM) - 60) / 140)).otherwise(F.lit(0.0))
    raw = {
        "timbre": F.least(F.lit(1.0), F.sqrt(energy / n_mfcc)),
        "harmony": F.least(F.lit(1.0), chroma / n_chroma),
        "rhythm": 0.5 * tempo + 0.5 * _clamped(at(L.DANCEABILITY)),
        "brightness": 0.5 * _clamped(at(L.SPECTRAL_CENTROID))
        + 0.5 * _clamped(at(L.SPECTRAL_ROLLOFF)),
        "intensity": 0.6 * _clamped(at(L.LOUDNESS)) + 0.4 * _clamped(at(L.ZERO_CROSSING_RATE)),
    }
    short = F.size(vec) < L.HANDCRAFTED_DIM
    return {axis: F.when(short, F.lit(0.0)).otherwise(F.round(raw[axis], decimals))
            for axis in AXES}
