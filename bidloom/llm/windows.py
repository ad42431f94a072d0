"""Hashes of all windows of a length in a batch of texts, and content-chosen anchors, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, kept between batches."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and each text's length."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.fromiter(map(len, texts), np.int64, len(texts))


def prefix(flat: np.ndarray, powers: Powers) -> np.ndarray:
    """Running sums from which window() gets the hash of any window."""
    _, down = powers.upto(len(flat) + 1)
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(0x1F123BB5)) * _BASE * down[: len(flat)], out=out[1:])
    return out


def window(sums: np.ndarray, size: int, powers: Powers, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of ``size`` at all starts, or at the starts ``at``; equal text gives equal hashes in every batch.

    The polynomial is taken modulo 2**64, which is sound for windows below 1024 characters.
    """
    up, _ = powers.upto(len(sums))
    if at is None:
        n = max(0, len(sums) - size)
        return _mix((sums[size:] - sums[:n]) * up[:n])
    return _mix((sums[at + size] - sums[at]) * up[at])


def sliding(x: np.ndarray, size: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over x[i:i+size] for every i up to len(x)-size."""
    n = len(x)
    if n < size:
        return x[:0]
    padded = np.full(-(-n // size) * size, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, size)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - size + 1], ahead[size - 1 : n])


def anchors(flat: np.ndarray, lengths: np.ndarray, sums: np.ndarray, size: int, span: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of chosen windows of ``size``: of any ``span`` characters of one text at least one is chosen, and by these characters alone.

    Also the hash of every window, and for every start of ``span`` characters
    the least hash in them, which is that of the chosen one; 0 if they don't fit.
    """
    if len(flat) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = window(sums, size, powers)
    h = np.clip(h, np.uint64(1), _NONE - np.uint64(1))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
    h[left[: len(h)] < size] = _NONE
    width = span - size + 1
    least = sliding(h, width, np.minimum, int(_NONE))
    least[left[: len(least)] < span] = 0
    # least[i] belongs to the window of starts i..i+width-1; a start is chosen if it is the least of any of them
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(max(0, len(h) - len(least)), np.uint64)])
    most = sliding(around, width, np.maximum, 0)[: len(h)]
    return np.flatnonzero((h == most) & (h != _NONE)), h, least
