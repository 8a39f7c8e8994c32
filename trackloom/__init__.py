"""Movement-track analytics on Spark: cleaning, motion features, isolation forests, events."""

from trackloom.config import DEFAULT, TrackConfig
from trackloom.schema import FEATURES

__all__ = ["DEFAULT", "FEATURES", "TrackConfig"]
