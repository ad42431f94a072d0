"""A linear-chain conditional random field over binary features, in numpy.

Sequences are batched: a batch is an array of feature ids (rows, steps, slots),
where id 0 stands for no feature, and the length of each row. Training maximises
the conditional likelihood with Adam; decoding is Viterbi over whole batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    emit: np.ndarray  # (features, states); row 0 stays 0
    move: np.ndarray  # (states, states)
    start: np.ndarray  # (states,)

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = self.emit[features[..., 0]].copy()
        for k in range(1, features.shape[-1]):
            out += self.emit[features[..., k]]
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best states (rows, steps); -1 after a row's end. Longer rows are worked on alone once the others have ended."""
        rows, steps, states = scores.shape
        order = np.argsort(-lengths, kind="stable")
        scores, size = scores[order], lengths[order]
        move = self.move.astype(scores.dtype)
        best = scores[:, 0] + self.start.astype(scores.dtype)
        back = np.zeros((rows, steps, states), np.int8)
        live = np.searchsorted(-size, -np.arange(steps), side="left")  # rows longer than each step
        for t in range(1, steps):
            n = live[t]
            if n <= 48:
                cand = best[:n, :, None] + move[None]
                arg, new = cand.argmax(1), cand.max(1)
            else:
                new, arg = best[:n, :1] + move[0], np.zeros((n, states), np.int8)
                for k in range(1, states):
                    cand = best[:n, k : k + 1] + move[k]
                    better = cand > new
                    np.copyto(new, cand, where=better)
                    np.copyto(arg, np.int8(k), where=better)
            back[:n, t] = arg
            best[:n] = new + scores[:n, t]
        out = np.full((rows, steps), -1, np.int8)
        if steps:
            at, final, done = np.zeros(rows, np.int64), best.argmax(1), 0
            for t in range(steps - 1, -1, -1):
                n = live[t]
                at[done:n] = final[done:n]
                done = n
                out[:n, t] = at[:n]
                at[:n] = back[np.arange(n), t, at[:n]]
        back_to = np.empty_like(order)
        back_to[order] = np.arange(rows)
        return out[back_to]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(
    features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, n_features: int, n_states: int, rounds: int = 6, rate: float = 0.3, ridge: float = 1e-5, batch: int = 64
) -> Crf:
    """Fits on padded sequences; labels beyond a row's length are ignored.

    Adaptive gradient steps on batches of sequences of like length, in an order
    drawn once; deterministic. ``rounds`` are passes over all sequences.
    """
    slots = features.shape[2]
    crf = Crf(np.zeros((n_features, n_states)), np.zeros((n_states, n_states)), np.zeros(n_states))
    squares = [np.full_like(p, 1e-6) for p in (crf.emit, crf.move, crf.start)]
    order = np.argsort(lengths, kind="stable")
    parts = np.array_split(order, max(1, len(order) // batch))
    rng, one = np.random.default_rng(13), np.eye(n_states)

    def step(p: np.ndarray, sq: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
        sq[at] += g * g
        p[at] += rate * g / np.sqrt(sq[at])

    for _ in range(rounds):
        for k in rng.permutation(len(parts)):
            own = parts[k]
            size = lengths[own]
            steps = int(size.max())
            live = np.arange(steps)[None] < size[:, None]
            ids, gold = features[own, :steps], np.where(live, labels[own, :steps], 0)
            s = np.where(live[..., None], crf.scores(ids), 0)
            fwd, bwd = np.empty_like(s), np.zeros_like(s)
            fwd[:, 0] = s[:, 0] + crf.start
            for t in range(1, steps):
                fwd[:, t] = np.where(live[:, t, None], _lse(fwd[:, t - 1][:, :, None] + crf.move[None], 1) + s[:, t], fwd[:, t - 1])
            for t in range(steps - 2, -1, -1):
                bwd[:, t] = np.where(live[:, t + 1, None], _lse(crf.move[None] + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
            z = _lse(fwd[np.arange(len(own)), size - 1], 1)
            prob = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
            move = np.zeros((n_states, n_states))
            on = live[:, 1:]
            if on.any():
                pair = fwd[:, :-1][on][:, :, None] + crf.move[None] + (s[:, 1:] + bwd[:, 1:])[on][:, None, :] - z[np.nonzero(on)[0], None, None]
                move -= np.exp(pair).sum(0)
                np.add.at(move, (gold[:, :-1][on], gold[:, 1:][on]), 1)
            delta = ((one[gold] - prob) * live[..., None])[live]
            flat = ids[live].ravel()
            sort = np.argsort(flat, kind="stable")
            heads = np.flatnonzero(np.diff(flat[sort], prepend=-1))
            grads = np.add.reduceat(delta[sort // slots], heads)
            at = flat[sort][heads]
            keep = at > 0
            at, grads = at[keep], grads[keep]
            step(crf.emit, squares[0], grads - ridge * len(own) * crf.emit[at], at)
            step(crf.move, squares[1], move - ridge * len(own) * crf.move)
            step(crf.start, squares[2], (one[gold[:, 0]] - prob[:, 0]).sum(0) - ridge * len(own) * crf.start)
    return crf
