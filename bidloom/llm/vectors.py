"""Problem 6: the most similar vectors of every vector, by collision counting.

Vectors are first put into coarse cells (nearest of centroids fitted on a
bounded sample; a vector near a border goes into every cell within MARGIN, so
that near vectors meet). In a cell, the vectors' differences from the centroid
are projected on single random directions, and each direction keeps a sorted
array of basic buckets. A query's window in each array is centred on the query
and is expanded level by level by virtual rehashing (a level joins twice as many
basic buckets); vectors that fall into the query's windows at least as often as
the level's threshold are verified by their cosine. A query stops when it has k
verified neighbours that are nearer than the next level could add. Then its k-th
cosine (or the least one asked for) says for unseen vectors how near the
differences from the centroid would have to be, and with it how many collisions a
nearer vector has at least; those that have them are verified too. In a tight
group, where differences say little, that is up to every vector of the cell.

A sorted array is kept as one bit a vector for each bucket bound, so a window is
the difference of two bit rows, and the collisions of 64 vectors with a query are
counted together by adders over the bits of the counts. Only vectors over the
threshold are ever met one by one.

Scale: a cell is cut into chunks, and a task gets one chunk of queries and one of
vectors, so a cell with a third of all vectors is many tasks of bounded size. The
centroids' number is fixed, so what is sent to every task is bounded. Every vector
is indexed; recall against brute force is measured in the tests. With a fixed
number of cells the counting grows with the square of a cell's vectors: about
ten operations for a pair in a cell, a fortieth of what its cosine costs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.llm.sampling import sampled
from bidloom.session import materialise

DIMENSION, K, MIN_COSINE = 384, 10, 0.80
#: Bound of the sample that the centroids are fitted on, their number, and how much less near a further cell may be.
SAMPLE, CELLS, MARGIN = 6144, 96, 0.08
DIRECTIONS = 96
#: Half widths of the windows by level, in units of the projections of a unit vector, each twice the last.
LEVELS = (0.5, 1.0)
#: A level's windows miss hardly any vector nearer than this cosine; a query with k of them needs no further level.
SURE = (0.93, -1.0)
#: Collisions of DIRECTIONS that make a candidate, by level.
FOUND_COLLISIONS = (50, 62)
TOP_COLLISIONS = (30, 38)
#: Standard deviations below the expected collisions of a vector at the k-th cosine that still count as possible.
DEVIATIONS = 3
#: Bound of the error of a cosine in single precision.
SLACK = 1e-5
QUERIES, VECTORS, AT_ONCE = 8192, 16384, 64
#: Projections are rounded to basic buckets of this width, GRID of them around 0; what lies beyond is put into the outermost.
BUCKET, GRID = 1 / 16, 128
#: Vectors of one stretch of the cosine with the centroid share a threshold.
STRETCHES = 16


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        sizes = np.diff(lists.offsets.to_numpy())
        ok = (sizes == DIMENSION) & lists.is_valid().to_numpy(zero_copy_only=False) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(ok)
        values = lists.values.to_numpy(zero_copy_only=False)
        v = values[lists.offsets.to_numpy()[:-1][rows][:, None] + np.arange(DIMENSION)].astype(np.float64) if len(rows) else np.zeros((0, DIMENSION))
        norm = np.sqrt((v * v).sum(1))
        fine = np.isfinite(norm) & (norm > 0)
        v = (v[fine] / norm[fine][:, None]).astype(np.float32)
        ids = batch.column("vec_id").take(pa.array(rows[fine]))
        yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in v], pa.binary())], names=["vec_id", "v"])


def usable(cache: DataFrame) -> DataFrame:
    """(vec_id, v): the usable vectors at unit length, as bytes. Null, shorter, zero, NaN and infinite ones are left out; repeated rows count once."""
    return cache.select("vec_id", "embedding").mapInArrow(_unit, "vec_id long, v binary").dropDuplicates(["vec_id"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIMENSION)


def centroids(sample: np.ndarray, cells: int = CELLS, rounds: int = 12) -> np.ndarray:
    """Directions of the cells: k-means on the sphere; of those nearer than 0.55 to a larger one only that one stays."""
    rng = np.random.default_rng(11)
    if not len(sample):
        return np.eye(1, DIMENSION, dtype=np.float32)
    cells = min(cells, len(sample))
    near = np.full(len(sample), -1.0, np.float32)
    chosen = [int(rng.integers(len(sample)))]
    for _ in range(cells - 1):
        near = np.maximum(near, sample @ sample[chosen[-1]])
        weight = np.clip(1 - near, 1e-9, None) ** 2
        chosen.append(int(rng.choice(len(sample), p=weight / weight.sum())))
    c = sample[chosen].copy()
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        for k in range(len(c)):
            mine = sample[own == k]
            if len(mine):
                c[k] = mine.sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    kept: list[np.ndarray] = []
    for row in c[np.argsort(-np.bincount((sample @ c.T).argmax(1), minlength=len(c)), kind="stable")]:
        if all(row @ k < 0.55 for k in kept):
            kept.append(row)
    return np.array(kept, np.float32)


def _cells(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = _matrix(batch.column("v")) @ c.T
            best = score.max(1, keepdims=True)
            row, cell = np.nonzero(score >= best - MARGIN)
            home = score.argmax(1)[row] == cell
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(home)],
                names=["vec_id", "v", "cell", "home"],
            )

    return run


def _least_collisions(half: float) -> np.ndarray:
    """By hundredth of the cosine of two differences from -1 on: the collisions of DIRECTIONS that such a pair has at least."""
    p = np.array([math.erf(half / (2 * math.sqrt(1 - r / 100))) for r in range(-100, 96)])
    return np.floor(DIRECTIONS * p - DEVIATIONS * np.sqrt(DIRECTIONS * p * (1 - p)))


def _verified(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with a cosine of at least ``least``, with it. Many pairs of few rows are first compared in single precision by one product of matrices."""
    if len(row) * 64 > len(q) * len(x):
        near = (q @ x.T)[row, col] >= least - SLACK
        row, col = row[near], col[near]
    cosine = np.empty(len(row))
    for b in range(0, len(row), 1 << 14):
        s = slice(b, b + (1 << 14))
        cosine[s] = np.einsum("ij,ij->i", q[row[s]], x[col[s]], dtype=np.float64)
    ok = cosine >= least
    return row[ok], col[ok], cosine[ok]


def _kth(row: np.ndarray, cosine: np.ndarray, rows: int, k: int, least: float) -> np.ndarray:
    """For each row its cosine of place ``k`` from 0, ``least`` if it has fewer."""
    order = np.lexsort((-cosine, row))
    first = np.searchsorted(row[order], np.arange(rows))
    has = np.bincount(row, minlength=rows) > k
    kth = np.full(rows, least)
    kth[has] = cosine[order[first[has] + k]]
    return kth


class _Counted:
    """Collisions of queries with all vectors, as bit planes of the counts."""

    def __init__(self, bits: np.ndarray, buckets: np.ndarray, wide: int) -> None:
        lo, hi = np.clip(buckets - wide, 0, GRID), np.clip(buckets + wide + 1, 0, GRID)
        waiting: list[list[np.ndarray]] = [[] for _ in range(9)]

        def put(x: np.ndarray, weight: int) -> None:
            own = waiting[weight]
            own.append(x)
            if len(own) == 3:
                a, b, c = own
                half = a ^ b
                waiting[weight] = [half ^ c]
                put((a & b) | (half & c), weight + 1)

        for j in range(bits.shape[0]):
            put(bits[j, hi[:, j]] ^ bits[j, lo[:, j]], 0)
        self.planes = []
        for weight in range(8):
            own = waiting[weight]
            if len(own) == 2:
                a, b = own
                waiting[weight + 1].append(a & b)
                own = [a ^ b]
                if len(waiting[weight + 1]) == 3:
                    x, y, z = waiting[weight + 1]
                    waiting[weight + 1] = [x ^ y ^ z]
                    waiting[weight + 2].append((x & y) | ((x ^ y) & z))
            self.planes.append(own[0] if own else None)

    def at_least(self, least: np.ndarray) -> np.ndarray:
        """Bits of the vectors with at least ``least`` collisions; ``least`` is (queries, 1) or (queries, words)."""
        more, same = np.uint64(0), ~np.uint64(0)
        for weight in range(7, -1, -1):
            want = np.where(least >> weight & 1, ~np.uint64(0), np.uint64(0))
            plane = self.planes[weight]
            if plane is None:
                plane = np.uint64(0)
            more = more | (same & plane & ~want)
            same = same & ~(plane ^ want)
        return more | same


def _pairs_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the set bits."""
    at = np.flatnonzero(words.ravel())
    bits = np.unpackbits(words.ravel()[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return at[which] // words.shape[1], at[which] % words.shape[1] * 64 + bit


def collide(q: np.ndarray, x: np.ndarray, c: np.ndarray, directions: np.ndarray, collisions: tuple[int, ...], k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, cosine) of verified candidates, the best k + 1 or more of each query with a cosine of at least ``least``."""

    def project(v: np.ndarray) -> np.ndarray:
        r = v - np.outer(v @ c, c)
        r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-9)
        return np.clip(np.floor(r @ directions / BUCKET).astype(np.int32) + GRID // 2, 0, GRID - 1)

    order = np.argsort(x @ c, kind="stable")
    x = x[order]
    n, words = len(x), -(-len(x) // 64)
    along = x @ c
    zx = project(x)
    bits = np.zeros((zx.shape[1], GRID + 1, words * 8), np.uint8)
    for j in range(zx.shape[1]):
        below = zx[:, j][None] < np.arange(GRID + 1)[:, None]
        bits[j, :, : -(-n // 8)] = np.packbits(below, axis=1, bitorder="little")
    bits = bits.view(np.uint64)
    # stretches of whole words, with the bounds of the cosine to the centroid in them
    cuts = np.unique(np.linspace(0, words, min(STRETCHES, words) + 1).astype(int))
    low, high = along[np.minimum(cuts[:-1] * 64, n - 1)], along[np.minimum(cuts[1:] * 64, n) - 1]
    possible_from = [_least_collisions(half) for half in LEVELS]
    out: tuple[list, list, list] = ([], [], [])

    def keep(rows: np.ndarray, row: np.ndarray, col: np.ndarray, cosine: np.ndarray) -> None:
        out[0].append(rows[row])
        out[1].append(order[col])
        out[2].append(cosine)

    for a in range(0, len(q), AT_ONCE):
        part = q[a : a + AT_ONCE]
        zq = project(part)
        open_ = np.arange(len(part))
        for level, (half, need) in enumerate(zip(LEVELS, collisions, strict=True)):
            if not len(open_):
                break
            own = part[open_]
            counted = _Counted(bits, zq[open_], round(half / BUCKET))
            row, col, cosine = _verified(own, x, *_pairs_of(counted.at_least(np.full((len(open_), 1), need))), least)
            # the query itself is among the vectors
            done = np.bincount(row[cosine >= SURE[level]], minlength=len(open_)) > k
            done |= level == len(LEVELS) - 1
            ends = np.flatnonzero(done)
            if len(ends):
                mine = done[row]
                keep(open_ + a, row[mine], col[mine], cosine[mine])
                kth = _kth(row, cosine, len(open_), k, least)[ends] - SLACK
                aq = own[ends] @ c
                oq = np.sqrt(np.maximum(1 - aq**2, 0))
                # the least cosine of differences that gives the k-th one is where along is nearest to along of the query / k-th
                at = np.clip((aq / np.where(np.abs(kth) < 1e-6, 1e-6, kth))[:, None], low[None], high[None])
                at = np.where(kth[:, None] > 0, at, high[None] if np.all(aq >= 0) else np.where(aq[:, None] >= 0, high[None], low[None]))
                must = (kth[:, None] - aq[:, None] * at) / np.maximum(oq[:, None] * np.sqrt(np.maximum(1 - at**2, 0)), 1e-6)
                enough = possible_from[level][np.floor(np.clip(must, -1, 0.95) * 100).astype(np.int16) + 100].astype(np.int64)
                enough = np.repeat(np.clip(enough, 0, need), np.diff(cuts), axis=1)
                if (enough < need).any():
                    counted.planes = [None if p is None else p[ends] for p in counted.planes]
                    more = counted.at_least(enough) & ~counted.at_least(np.full((len(ends), 1), need))
                    more[:, -1] &= np.uint64((1 << (n - 64 * (words - 1))) - 1) if n % 64 else ~np.uint64(0)
                    # queries that most vectors are near to are compared with all at once
                    many = np.bitwise_count(more).sum(1) * 12 > n
                    keep(open_[ends] + a, *_verified(own[ends], x, *_pairs_of(np.where(many[:, None], np.uint64(0), more)), least))
                    if many.any():
                        every = own[ends[many]] @ x.T
                        best = np.partition(every, -min(k + 1, n), axis=1)[:, -min(k + 1, n), None]
                        row, col = np.nonzero(every >= np.maximum(best, least) - SLACK)
                        keep(open_[ends[many]] + a, *_verified(own[ends[many]], x, row, col, least))
            open_ = open_[~done]
    return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in out)


def _block(c: np.ndarray, collisions: tuple[int, ...], k: int, least: float):
    directions = np.random.default_rng(7).standard_normal((DIMENSION, DIRECTIONS)).astype(np.float32)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy()
        ids = table.column("vec_id").to_numpy()
        m = _matrix(table.column("v"))
        q, x = np.flatnonzero(asks), np.flatnonzero(~asks)
        if len(q) and len(x):
            row, col, cosine = collide(m[q], m[x], c[key[0].as_py()], directions, collisions, k, least)
            a, b = ids[q][row], ids[x][col]
            ok = a != b
            a, b, cosine = a[ok], b[ok], cosine[ok]
            order = np.lexsort((b, -cosine, a))
            a, b, cosine = a[order], b[order], cosine[order]
            once = np.ones(len(a), bool)
            once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, cosine = a[once], b[once], cosine[once]
            fresh = np.ones(len(a), bool)
            fresh[1:] = a[1:] != a[:-1]
            place = np.arange(len(a)) - np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0)) if len(a) else np.zeros(0)
            keep = place < k
            a, b, cosine = a[keep], b[keep], cosine[keep]
        else:
            a = b = np.zeros(0, np.int64)
            cosine = np.zeros(0)
        return pa.table({"vec_id": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "cosine": pa.array(cosine, pa.float64())})

    return run


def neighbours(cache: DataFrame, asks=None, k: int = K, least: float = -1.0, collisions: tuple[int, ...] = TOP_COLLISIONS) -> DataFrame:
    """(vec_id, rank, other, cosine): up to k most similar other vectors of each query.

    ``asks`` is a condition on vec_id that says which vectors are queries (all,
    if None); all vectors are searched. Equal cosines are ranked by vec_id.
    """
    units = materialise(usable(cache))
    sample = sampled(units, "vec_id", SAMPLE)
    c = centroids(np.frombuffer(b"".join(bytes(r["v"]) for r in sample), np.float32).reshape(-1, DIMENSION))
    placed = units.mapInArrow(_cells(c), "vec_id long, v binary, cell int, home boolean")
    is_query = F.col("home") & (asks if asks is not None else F.lit(True))
    sizes = units.sparkSession.createDataFrame(
        [(int(r[0]), max(1, -(-int(r[1]) // QUERIES)), max(1, -(-int(r[2]) // VECTORS))) for r in placed.groupBy("cell").agg(F.count_if(is_query), F.count("*")).collect()],
        "cell int, q int, x int",
    )
    parts = placed.join(F.broadcast(sizes), "cell")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    h = F.xxhash64("vec_id")
    as_query = parts.filter(is_query).select("cell", F.pmod(h, "q").cast("int").alias("a"), F.explode(numbers("x")).alias("b"), F.lit(True).alias("query"), "vec_id", "v")
    as_data = parts.select("cell", F.explode(numbers("q")).alias("a"), F.pmod(h, "x").cast("int").alias("b"), F.lit(False).alias("query"), "vec_id", "v")
    found = as_query.union(as_data).groupBy("cell", "a", "b").applyInArrow(_block(c, collisions, k, least), "vec_id long, other long, cosine double")
    order = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("vec_id", "rank", "other", F.round("cosine", 6).alias("cosine"))


def found(cache: DataFrame, k: int = K, least: float = MIN_COSINE) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b, with a cosine of at least ``least``, one among the k most similar of the other."""
    near = neighbours(cache, None, k, least, FOUND_COLLISIONS)
    return near.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()
