"""Byte-level pair merges as a lazily determinised transducer, and a streaming decoder.

Reading a piece byte by byte, only the bytes that could still be inside a token
matter: the longest suffix that begins some token (the window). A state is that
window, with the way each prefix that ends in it is encoded since the last token
all of them share. That token and those before it can't change any more and are
emitted. The prefixes' last tokens are extended by the tokens that end at the new
byte and fit: a token fits if it and the last token before it stay apart when
their bytes are merged together. States and moves are made when first met, and
moves are kept by whole characters.
"""

from __future__ import annotations

import base64
from functools import lru_cache

TOKENIZER = "byte_bpe_50k.tiktoken"


class Transducer:
    #: Bytes that kept states and moves, and answers of fits(), may take each; beyond that all are dropped and made anew when met.
    BYTES, ENTRY = 128 << 20, 260

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.begins = {b[:k] for b in ranks for k in range(1, len(b) + 1)}
        self.fitting: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.keys: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.held = 0
        self.moves: dict[tuple[int, str], tuple[int, tuple[int, ...]]] = {}
        self.start = self._state((b"", ((-1, ()),)))

    def _state(self, key: tuple) -> int:
        got = self.keys.get(key)
        if got is None:
            got = self.keys[key] = len(self.states)
            self.states.append(key)
            self.held += self.ENTRY + len(key[0]) + 130 * len(key[1])
        return got

    def merged(self, data: bytes) -> list[int]:
        """The definition: the pair with the least rank is merged first, from the left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens stay as they are side by side; before -1 is the beginning."""
        key = (before + 1 << 32) + token
        got = self.fitting.get(key)
        if got is None:
            if len(self.fitting) * 110 > self.BYTES:
                self.fitting.clear()
            if before < 0:
                got = self.merged(self.bytes_of[token]) == [token]
            else:
                got = self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
            self.fitting[key] = got
        return got

    def _byte(self, key: tuple, byte: bytes) -> tuple[tuple, tuple[int, ...]]:
        seen, prefixes = key
        text = seen + byte
        # prefixes[k] belongs to the place len(seen) - k from the end, oldest last
        for k in range(len(prefixes)):
            token = self.ranks.get(text[len(seen) - k :])
            if token is not None and self.fits(-1, token) and (prefixes[k][0] < 0 or self.fits(prefixes[k][0], token)):
                new = (token, (*prefixes[k][1], token))
                break
        else:
            raise AssertionError("every byte is a token")
        prefixes = (new, *prefixes)
        window = text
        while window and window not in self.begins:
            window = window[1:]
        prefixes = prefixes[: len(window) + 1]
        shared = 0
        shortest = min(len(p) for _, p in prefixes)
        while shared < shortest and len({p[shared] for _, p in prefixes}) == 1:
            shared += 1
        out = prefixes[0][1][:shared]
        return (window, tuple((last, p[shared:]) for last, p in prefixes)), out

    def step(self, state: int, char: str) -> tuple[int, tuple[int, ...]]:
        if self.held > self.BYTES:
            key = self.states[state]
            self._reset()
            state = self._state(key)
        key, out = self.states[state], ()
        for b in char.encode("utf-8", "surrogatepass"):
            key, more = self._byte(key, bytes([b]))
            out += more
        got = self.moves[state, char] = (self._state(key), out)
        self.held += self.ENTRY + 8 * len(out)
        return got

    def encode(self, piece: str) -> list[int]:
        """The ids of one piece of text that no merge may cross."""
        state, out, moves = self.start, [], self.moves
        for char in piece:
            got = moves.get((state, char))
            if got is None:
                got = self.step(state, char)
                moves = self.moves
            state = got[0]
            if got[1]:
                out += got[1]
        out += self.states[state][1][0][1]
        return out


class Utf8Stream:
    """An incremental UTF-8 state machine: bytes in any portions in, whole characters out; bad bytes become U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(tail: bytes) -> int:
        """Bytes at the end that begin a character without ending it."""
        for k in range(1, min(3, len(tail)) + 1):
            lead = tail[-k]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return k if k < need else 0
            if lead < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._open(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


def read_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Token -> id of a vocabulary file's bytes."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}


@lru_cache(2)
def load(vocabulary: bytes) -> Transducer:
    return Transducer(read_ranks(vocabulary))
