"""Problem 10: repetition inside a single document.

A document is a sequence of segments: its lines, cut every SEGMENT letters. A
linear-chain conditional random field, decoded by Viterbi, labels each segment as
content or as boilerplate (text said before in the document), from how much of it
repeats, how long such stretches are, its length, place and digits. The content
share decides which documents are held: one whose boilerplate segments have at
least CANDIDATE of the letters is judged repetitive. A segment may be boilerplate
in part only, so a held document is then checked by its exact share of repeated
letters, which the report gives for every document.

Segments are as long as the shortest stretch that counts, so a stretch fills at
least half of one: a document with SHARE of its letters in stretches has half of
that in segments that repeat by half or more, which is more than CANDIDATE.

Everything is per document, in one pass over the table without a shuffle. The
field is fitted on at most TRAIN_DOCS documents of at most TRAIN_LETTERS
characters each, labelled by the exact definition; fitting needs no more whatever
the size of the table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.crf import Crf, train
from bidloom.llm.letters import letter_table
from bidloom.llm.sampling import sampled
from bidloom.llm.windows import Powers, codes, prefix, window

STRETCH = 40
SHARE = 0.3
#: Bounds of the labelled sample; longer documents are no examples.
TRAIN_DOCS, TRAIN_LETTERS = 600, 12_000
#: Letters after which a line is cut.
SEGMENT = 40
#: Least share of letters in segments labelled boilerplate of a document that is held.
CANDIDATE = 0.1
_BINS = (np.array([1e-9, 0.25, 0.5, 0.75, 0.95]), np.array([8, 16, 24, 40]), np.array([0.25, 0.5, 0.75]), np.array([0.02, 0.1, 0.3]))
_SIZES = [len(b) + 1 for b in _BINS]
FEATURES = 1 + sum(_SIZES) + 2
CHUNK = 1 << 19


class _Documents:
    """The letters, segments and features of some documents."""

    def __init__(self, texts: list[str], powers: Powers) -> None:
        flat, lengths = codes([t.lower() for t in texts])
        doc = np.repeat(np.arange(len(texts)), lengths)
        is_letter = letter_table()[flat]
        self.n = len(texts)
        self.letters = flat[is_letter]
        self.doc = doc[is_letter]
        line = np.cumsum(flat == 10)
        self.counts = np.bincount(self.doc, minlength=self.n)
        self.ends = np.cumsum(self.counts)
        self.powers = powers
        self.sums = prefix(self.letters, powers)
        self.marks = self.repeated()
        # segments: a new one at each line, document and after SEGMENT letters
        own = line[is_letter]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (self.doc[1:] != self.doc[:-1])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
        fresh |= (np.arange(len(own)) - begin) % SEGMENT == 0
        self.segment = np.cumsum(fresh) - 1
        self.first = np.flatnonzero(fresh)
        self.segment_doc = self.doc[self.first]
        # digits are counted to the segment of the letters before them
        digit = np.flatnonzero((flat >= 48) & (flat <= 57))
        at = np.cumsum(is_letter)[digit] - 1
        ok = at >= 0
        digits = np.bincount(self.segment[at[ok]], minlength=len(self.first)) if len(self.first) else np.zeros(0)
        self.size = np.diff(np.append(self.first, len(self.letters)))
        self.digit_share = digits[: len(self.first)] / np.maximum(self.size, 1)

    def seen_before(self, size: int) -> np.ndarray:
        """Starts of windows of ``size`` letters that equal an earlier one of the same document."""
        at = np.arange(max(0, len(self.letters) - size + 1))
        at = at[at + size <= self.ends[self.doc[at]]]
        h = window(self.sums, size, self.powers, at)
        h ^= self.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        again = np.zeros(len(h), bool)
        again[order[1:]] = ordered[1:] == ordered[:-1]
        return at[again]

    def repeated(self) -> np.ndarray:
        """Which letters lie in stretches of STRETCH letters that repeat an earlier one."""
        at = self.seen_before(STRETCH)
        marks = np.zeros(len(self.letters) + 1, np.int32)
        marks[: len(self.letters)] += np.bincount(at, minlength=len(self.letters)).astype(np.int32)
        marks -= np.bincount(at + STRETCH, minlength=len(marks)).astype(np.int32)[: len(marks)]
        return np.cumsum(marks[:-1]) > 0

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segments, 5) feature ids, segments of each document, row of each segment."""
        n = len(self.first)
        again = np.add.reduceat(self.marks, self.first) if n else np.zeros(0)
        share = again / np.maximum(self.size, 1)
        ends = self.ends[self.segment_doc] if n else np.zeros(0)
        place = 1 - (ends - self.first) / np.maximum(self.counts[self.segment_doc], 1) if n else np.zeros(0)
        ids = np.zeros((n, 5), np.int64)
        base = 1
        for k, (bins, x) in enumerate(zip(_BINS, (share, self.size, place, self.digit_share), strict=True)):
            ids[:, k] = base + np.digitize(x, bins)
            base += len(bins) + 1
        # whether the segment's first letter goes on a repeated stretch from the segment before
        inner = self.first > 0
        ids[:, 4] = base + (inner & self.marks[np.maximum(self.first - 1, 0)] & (self.doc[np.maximum(self.first - 1, 0)] == self.segment_doc)) if n else base
        per = np.bincount(self.segment_doc, minlength=self.n)
        step = np.arange(n) - np.repeat(np.cumsum(per) - per, per)
        return ids, per, step


def _padded(ids: np.ndarray, per: np.ndarray, step: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), int(per[rows].max(initial=1)), ids.shape[1]), np.int64)
    where = np.full(len(per), -1)
    where[rows] = np.arange(len(rows))
    mine = where[docs] >= 0
    out[where[docs[mine]], step[mine]] = ids[mine]
    return out


def _labels(crf: Crf, d: _Documents) -> np.ndarray:
    """For each segment, whether the field labels it repetition. Documents of like length are decoded together."""
    ids, per, step = d.features()
    label = np.zeros(len(ids), np.int8)
    order = np.argsort(per, kind="stable")
    order = order[per[order] > 0]
    begins = np.cumsum(per) - per
    for part in np.array_split(order, max(1, len(order) // 64)) if len(order) else []:
        x = _padded(ids, per, step, part, d.segment_doc)
        got = crf.viterbi(crf.scores(x), per[part])
        live = np.arange(x.shape[1])[None] < per[part][:, None]
        where = (begins[part][:, None] + np.arange(x.shape[1])[None])[live]
        label[where] = got[live]
    return label


def _strewn(texts: list[str], number: int) -> list[str]:
    """Texts with one of their phrases put into many of their lines, so that the field sees short repetitions between content too."""
    rng, out = random.Random(31), []
    for t in texts[:number]:
        at, size = rng.randrange(max(1, len(t) - 60)), rng.choice((50, 60, 80, 120, 200))
        phrase = " ".join(t[at : at + size].split())
        lines = [t[k : k + 110] for k in range(0, min(len(t), 4000), 110)]
        out.append("\n".join(rng.choice((f"{x} {phrase}", f"{phrase} {x}", x)) for x in lines))
    return out


def fit(texts: list[str]) -> Crf:
    """The field, fitted on texts, and on some made of them, labelled by the exact definition."""
    d = _Documents(texts + _strewn(texts, 200), Powers())
    ids, per, step = d.features()
    truth = np.add.reduceat(d.marks, d.first) >= 0.5 * d.size if len(ids) else np.zeros(0, bool)
    rows = np.flatnonzero(per > 0)
    if not len(rows):
        rows, per, d.segment_doc = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)
        ids, step, truth = np.zeros((1, 5), np.int64), np.zeros(1, np.int64), np.zeros(1, bool)
    x = _padded(ids, per, step, rows, d.segment_doc)
    y = _padded(truth.astype(np.int64)[:, None], per, step, rows, d.segment_doc)[..., 0]
    return train(x, per[rows], y, FEATURES, 2, rounds=6)


def _share_rows(crf: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = np.cumsum([len(t) for t in texts])
            cuts = np.flatnonzero(np.diff(sizes // CHUNK)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                d = _Documents(texts[a:b], powers)
                total = np.maximum(d.counts, 1)
                labelled = np.bincount(d.segment_doc, d.size * _labels(crf, d), minlength=d.n) / total if len(d.first) else np.zeros(d.n)
                exact = np.bincount(d.doc, d.marks, minlength=d.n) / total
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array(d.counts, pa.int64()), pa.array(labelled, pa.float64()), pa.array(exact, pa.float64())],
                    names=["doc_id", "letters", "labelled_share", "repeated_share"],
                )

    return run


def shares(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, letters, labelled_share, repeated_share) of every document.

    ``labelled_share`` is that of letters in segments labelled boilerplate. Null,
    empty and letterless texts have 0 letters and shares of 0; of repeated rows
    with different texts each gives a row.
    """
    rows = documents.select("doc_id", "text")
    crf = fit([r["text"] for r in sampled(rows.filter(F.length("text").between(1, TRAIN_LETTERS)), "doc_id", train_docs)])
    return rows.mapInArrow(_share_rows(crf), "doc_id long, letters long, labelled_share double, repeated_share double")


def found(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id): documents held for their labelled share of which at least ``share`` of the letters repeat."""
    held = shares(documents).filter(F.col("labelled_share") >= CANDIDATE)
    return held.filter(F.col("repeated_share") >= share).select("doc_id").distinct()
