"""Problem 8: encoding of the whole corpus with a public byte-level tokenizer.

Texts are cut into pieces by the tokenizer's pattern, over all texts of a batch
at once in numpy; each distinct piece of a batch goes through the transducer of
bpe.py once, and its ids are copied to every place where it stands. Pieces are
grouped by hash and then compared character by character with the first of their
group, so two pieces of one hash are told apart. One pass over the table, no
shuffle; texts are encoded in chunks of about CHUNK characters. The vocabulary
file's path is a parameter; the driver reads it and ships its bytes with the job.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bidloom.llm import bpe
from bidloom.llm.windows import Powers, codes, prefix

FOLDER = "/opt/tokenizers"
VOCABULARY = f"{FOLDER}/byte_bpe_50k.tiktoken"
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: The characters of Unicode's White_Space property.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK = 1 << 19


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[_WHITE] = _SPACE
    return out


def piece_starts(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts begin.

    A piece is a run of letters, of numbers or of other characters with the blank
    before it; white space up to the last one before a run; or, where an
    apostrophe begins a piece, it with s, t, m, d, re, ve or ll.
    """
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[flat]
    text_start = np.zeros(n + 1, bool)
    text_start[np.cumsum(lengths) - lengths] = True
    text_start = text_start[:n]
    space = kind == _SPACE
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run |= text_start
    begin = run.copy()
    # the last white space before a run in the same text stands alone, or goes with the run if it's a blank
    runs = np.flatnonzero(run[1:] & ~text_start[1:] & space[:-1] & ~space[1:]) + 1
    begin[runs - 1] = True
    blank = flat[runs - 1] == 32
    begin[runs[blank]] = False
    # contractions: a lone apostrophe that begins a piece
    at = np.flatnonzero(begin[: n - 1] & (flat[: n - 1] == 39) & (kind[1:] == _LETTER) & ~text_start[1:])
    if len(at):
        c1 = flat[at + 1]
        ok2 = at + 2 < n
        c2 = np.where(ok2, flat[np.minimum(at + 2, n - 1)], 0)
        same = ok2 & ~text_start[np.minimum(at + 2, n - 1)]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = same & (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l")))
        for mask, size in ((one, 2), (two, 3)):
            x = at[mask]
            begin[x + 1] = False
            after = x + size
            after = after[after < n]
            begin[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes lists of texts; keeps the ids of short pieces it has met, up to KEPT_BYTES."""

    KEPT_BYTES, SHORT, ENTRY = 48 << 20, 48, 220

    def __init__(self, vocabulary: bytes) -> None:
        self.transducer = bpe.load(vocabulary)
        self.powers = Powers()
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _ids(self, piece: str) -> tuple[int, ...] | list[int]:
        if len(piece) > self.SHORT:
            return self.transducer.encode(piece)
        got = self.known.get(piece)
        if got is None:
            got = tuple(self.transducer.encode(piece))
            self.held += self.ENTRY + 4 * len(piece) + 8 * len(got)
            if self.held > self.KEPT_BYTES:
                self.known.clear()
                self.held = 0
            self.known[piece] = got
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        flat, lengths = codes(texts)
        begin = piece_starts(flat, lengths)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        end = np.append(begin[1:], len(flat))
        size = end - begin
        sums = prefix(flat, self.powers)
        up, _ = self.powers.upto(len(sums))
        # equal pieces have equal hashes wherever they stand
        h = (sums[end] - sums[begin]) * up[begin]
        h ^= h >> np.uint64(31)
        h = h * np.uint64(0x94D049BB133111EB) + size.astype(np.uint64)
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        # a piece that isn't the first of its hash character by character stands for itself
        inner = np.arange(len(flat)) - np.repeat(begin, size)
        head = np.repeat(begin[first[place]], size)
        differs = flat != flat[np.minimum(head + inner, len(flat) - 1)]
        differs = (np.add.reduceat(differs, begin) > 0) | (size != size[first[place]])
        if differs.any():
            own = np.flatnonzero(differs)
            place[own] = len(first) + np.arange(len(own))
            first = np.concatenate([first, own])
        whole, of = "".join(texts), self._ids
        ids = [of(whole[a:b]) for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        table = np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum()))
        starts = np.cumsum(counts) - counts
        per = counts[place]
        total = int(per.sum())
        offset = np.repeat(starts[place] - (np.cumsum(per) - per), per)
        out = table[offset + np.arange(total)]
        text = np.searchsorted(np.cumsum(lengths), begin, side="right")
        return out, np.bincount(text, per, len(texts)).astype(np.int64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum([len(t) for t in texts])
    cuts = np.flatnonzero(np.diff(sizes // CHUNK)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True)


def _shipped(df: DataFrame, path: str):
    """The vocabulary file's bytes, read by the driver, as a broadcast of a megabyte."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _encode_rows(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            keys = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                ids, counts = encoder.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])

    return run


def _count_rows(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _encode_rows(vocabulary)(batches):
            offsets = batch.column(1).offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64))], names=["doc_id", "n_tokens"])

    return run


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the ids of each document's text, without special tokens, whose strings count as ordinary text.

    Null and empty texts have no ids: an empty list. One row for each row given.
    """
    return documents.select("doc_id", "text").mapInArrow(_encode_rows(_shipped(documents, path)), "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each document."""
    return documents.select("doc_id", "text").mapInArrow(_count_rows(_shipped(documents, path)), "doc_id long, n_tokens long")


def _decode_rows(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b, _ in sorted(bpe.read_ranks(vocabulary.value).items(), key=lambda x: x[1])]
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                stream, parts = bpe.Utf8Stream(), []
                for k in range(0, len(ids or ()), 4096):
                    parts.append(stream.feed(b"".join([table[i] for i in ids[k : k + 4096]])))
                texts.append("".join([*parts, stream.end()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    return tokens.select("doc_id", "ids").mapInArrow(_decode_rows(_shipped(tokens, path)), "doc_id long, text string")
