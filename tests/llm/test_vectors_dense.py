import numpy as np
import pytest

from bidloom.llm import vectors


@pytest.mark.parametrize("mean", [0.90, 0.93, 0.96])
def test_neighbours_in_one_tight_topic(mean):
    rng = np.random.default_rng(1)
    c = np.eye(1, vectors.DIMENSION, dtype=np.float32)[0]
    r = rng.standard_normal((4000, vectors.DIMENSION))
    r[:, 0] = 0
    x = (mean * c + np.sqrt(1 - mean**2) * r / np.linalg.norm(r, axis=1, keepdims=True)).astype(np.float32)
    q = x[:100]
    directions = np.random.default_rng(7).standard_normal((vectors.DIMENSION, vectors.DIRECTIONS)).astype(np.float32)
    row, col, _ = vectors.collide(q, x, c, directions, vectors.FOUND_COLLISIONS, vectors.K, vectors.MIN_COSINE)
    got = set(zip(row.tolist(), col.tolist(), strict=True))
    cosine = q @ x.T
    cosine[np.arange(len(q)), np.arange(len(q))] = -2
    want = {(i, int(j)) for i in range(len(q)) for j in np.argsort(-cosine[i])[: vectors.K] if cosine[i, j] >= vectors.MIN_COSINE}
    assert len(want) >= 900 and len(got & want) / len(want) > 0.99
