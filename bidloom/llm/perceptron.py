"""An averaged perceptron over binary features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Perceptron:
    weights: np.ndarray  # (features, classes)

    def predict(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(1).argmax(1)


def train(features: np.ndarray, labels: np.ndarray, n_features: int, n_classes: int, rounds: int = 8, seed: int = 3) -> Perceptron:
    """Fits on rows of feature ids. Deterministic; the mean of the weights over all steps is returned."""
    rng = np.random.default_rng(seed)
    w, total = np.zeros((n_features, n_classes)), np.zeros((n_features, n_classes))
    step = 1
    for _ in range(rounds):
        for i in rng.permutation(len(labels)):
            f, y = features[i], labels[i]
            got = int(w[f].sum(0).argmax())
            if got != y:
                for m, by in ((w, 1), (total, step)):
                    np.add.at(m[:, y], f, by)
                    np.add.at(m[:, got], f, -by)
            step += 1
    return Perceptron(w - total / step)
