"""Letters (Unicode category L) of texts, in numpy."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
