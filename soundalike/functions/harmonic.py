"""Keys, tempo and DJ mixing (inventory I17-I20, I22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundalike.functions.vectors import ColumnOrName, col

# Spelling of a key -> position on the Camelot wheel.
CAMELOT = {
    "A-flat major": "4B", "G# major": "4B",
    "E-flat major": "5B", "D# major": "5B",
    "B-flat major": "6B", "A# major": "6B",
    "F major": "7B",
    "C major": "8B",
    "G major": "9B",
    "D major": "10B",
    "A major": "11B",
    "E major": "12B",
    "B major": "1B",
    "F# major": "2B", "G-flat major": "2B",
    "D-flat major": "3B", "C# major": "3B",
    "F minor": "4A",
    "C minor": "5A",
    "G minor": "6A",
    "D minor": "7A",
    "A minor": "8A",
    "E minor": "9A",
    "B minor": "10A",
    "F# minor": "11A", "G-flat minor": "11A",
    "C# minor": "12A", "D-flat minor": "12A",
    "G# minor": "1A", "A-flat minor": "1A",
    "D# minor": "2A", "E-flat minor": "2A",
    "A# minor": "3A", "B-flat minor": "3A",
}


def camelot(key: ColumnOrName) -> Column:
    """Exact spelling lookup, NULL where unknown."""
    pairs = [F.lit(x) for item in CAMELOT.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col(key))


def spell_key(key: ColumnOrName, default_mode: str = "major") -> Column:
    """Long spelling of short notations: ``Am`` -> ``A minor``, ``Bb`` -> ``B-flat major``."""
    k = F.trim(col(key))
    long_form = k.rlike("(major|minor)$")
    minor = k.rlike("m$")
    tonic = F.regexp_replace(F.regexp_replace(k, "m$", ""), "b$", "-flat")
    return F.when(long_form, k).otherwise(
        F.concat_ws(" ", tonic, F.when(minor, F.lit("minor")).otherwise(F.lit(default_mode))))


def harmonic_compatibility(key_a: ColumnOrName, key_b: ColumnOrName) -> Column:
    """Perfect / compatible / incompatible, NULL where a key is unknown."""
    a, b = camelot(key_a), camelot(key_b)
    number_a = F.regexp_extract(a, "^[0-9]+", 0).cast("int")
    number_b = F.regexp_extract(b, "^[0-9]+", 0).cast("int")
    same_letter = F.right(a, F.lit(1)) == F.right(b, F.lit(1))
    gap = F.abs(number_a - number_b)
    steps = F.least(gap, 12 - gap)
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("string"))
            .when(same_letter & (steps <= 1), "perfect")
            .when((same_letter & (steps == 2)) | (~same_letter & (steps == 0)), "compatible")
            .otherwise("incompatible"))


def bpm_match(a: ColumnOrName, b: ColumnOrName) -> Column:
    """I19."""
    x, y = col(a).cast("double"), col(b).cast("double")
    ratio = F.abs(x - y) / F.greatest(x, y)
    return (F.when(x.isNull() | y.isNull() | (x == 0) | (y == 0), F.lit(None).cast("string"))
            .when(ratio <= 0.02, "exact").when(ratio <= 0.05, "close").otherwise("far"))


def round_half_up(x: ColumnOrName) -> Column:
    """Rounding towards +infinity on ties."""
    return F.floor(col(x) + 0.5).cast("long")


def bpm_difference(a: ColumnOrName, b: ColumnOrName) -> Column:
    """I20."""
    return round_half_up(col(b).cast("double") - col(a).cast("double"))


def minutes_seconds(sec: ColumnOrName) -> Column:
    """``m:ss``; empty where there is no duration."""
    s = F.floor(col(sec)).cast("long")
    return F.when(s.isNull(), F.lit("")).otherwise(
        F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60))
