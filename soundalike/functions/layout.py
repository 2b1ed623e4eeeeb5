"""Positions of the handcrafted feature vector and the focus categories over it.

Layouts are arguments everywhere; the values here are the defaults.
"""

from __future__ import annotations

# The 44 positions of the handcrafted vector.
HANDCRAFTED_DIM = 44
MFCC_MEAN = range(0, 13)
MFCC_STDEV = range(13, 26)
CHROMA = range(26, 38)
SPECTRAL_CENTROID = 38
SPECTRAL_ROLLOFF = 39
BPM = 40
ZERO_CROSSING_RATE = 41
LOUDNESS = 42
DANCEABILITY = 43

# Focus category -> positions.
FOCUS: dict[str, tuple[int, ...]] = {
    "timbre": tuple(range(0, 26)),
    "harmony": tuple(range(26, 38)),
    "rhythm": (40, 43),
    "brightness": (38, 39),
    "intensity": (41, 42),
}
