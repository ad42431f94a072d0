"""Problem 9: filling containers of fixed capacity with items.

Which lengths go together depends only on how many items of each length there
are, and there are at most as many lengths as the capacity. So the driver gets
counts by length (bounded by the capacity, whatever the data's size) and makes a
plan: patterns of lengths, and how often each is used. Gaps are filled exactly
first: for each length the complement is looked up among single lengths, sums of
pairs and sums of triples, as often as the counts allow. What remains goes best
fit, longest first. Then each item gets its number among the items of its length,
and the number tells its container.

Scale: items are numbered within (length, salt), with as many salts as the items
need, so a length that a third of all items have is no hot group. The plan has a
bounded number of entries for each length and is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.session import materialise

#: Items that one salt of one length may have.
SALTED = 1_000_000


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """(times, lengths): how often which lengths share a container; counts[n] items have length n, and the capacity is len(counts) - 1."""
    c = counts.astype(np.int64).copy()
    cap = len(c) - 1
    out: list[tuple[int, list[int]]] = []

    def use(lengths: list[int]) -> int:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(c[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                c[x] -= times * k
            out.append((times, lengths))
        return times

    if c[cap]:
        use([cap])
    pair_ok = np.zeros(cap + 1, bool)
    have = np.flatnonzero(c[1:cap]) + 1
    for a in have.tolist():
        s = a + have[(have >= a) & (have + a <= cap)]
        pair_ok[s] = True

    def pair(total: int) -> tuple[int, int] | None:
        if total < 2 or not pair_ok[total]:
            return None
        a = np.arange(1, total // 2 + 1)
        ok = (c[a] > 0) & (c[total - a] > 0)
        if total % 2 == 0:
            ok[-1] = c[total // 2] > 1
        hit = np.flatnonzero(ok)
        if not len(hit):
            pair_ok[total] = False
            return None
        return int(a[hit[-1]]), total - int(a[hit[-1]])

    for big in range(cap - 1, 0, -1):
        gap = cap - big
        if c[big] and gap <= big:
            use([big, gap])
        while c[big] and (p := pair(gap)):
            if not use([big, *p]):
                break
        while c[big]:
            d = np.flatnonzero((c[1:gap] > 0) & pair_ok[gap - 1 : 0 : -1]) + 1 if gap > 2 else np.zeros(0, np.int64)
            done = False
            for x in d.tolist():
                p = pair(gap - x)
                if p and use([big, x, *p]):
                    done = True
                    break
            if not done:
                break
    # best fit, longest first: open containers by the space left
    space: dict[int, list[tuple[int, list[int]]]] = {}
    open_ = np.zeros(cap + 1, bool)
    for big in range(cap - 1, 0, -1):
        while c[big]:
            fit = np.flatnonzero(open_[big:])
            if len(fit):
                left = big + int(fit[0])
                times, lengths = space[left].pop()
                if not space[left]:
                    open_[left] = False
                now = min(times, int(c[big]))
                if now < times:
                    space.setdefault(left, []).append((times - now, lengths))
                    open_[left] = True
            else:
                left, lengths = cap, []
                each = min(cap // big, int(c[big]))
                now = int(c[big]) // each
                lengths = [big] * (each - 1)
                left = cap - big * (each - 1)
                c[big] -= now * (each - 1)
            c[big] -= now
            left, lengths = left - big, [*lengths, big]
            space.setdefault(left, []).append((now, lengths))
            open_[left] = left > 0
    for groups in space.values():
        out += groups
    return out


def _demands(patterns: list[tuple[int, list[int]]], cap: int) -> dict[str, np.ndarray]:
    """By length and number: from which item on which container takes how many."""
    rows, taken, base = [], np.zeros(cap + 1, np.int64), 0
    for times, lengths in patterns:
        for x in sorted(set(lengths)):
            k = lengths.count(x)
            rows.append((x, taken[x], base, k))
            taken[x] += times * k
        base += times
    x = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": x[:, 0], "start": x[:, 1], "base": x[:, 2], "each": x[:, 3]}


def _assign(plans: dict[int, dict[str, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spec, length, number = (batch.column(n).to_numpy() for n in ("spec_id", "tokens", "number"))
            container = np.zeros(len(spec), np.int64)
            for s in np.unique(spec).tolist():
                mine, p = spec == s, plans[s]
                wide = int(p["start"].max(initial=0)) + int(number.max(initial=0)) + 2
                at = np.searchsorted(p["length"] * wide + p["start"], length[mine] * wide + number[mine], side="right") - 1
                container[mine] = p["base"][at] + (number[mine] - p["start"][at]) // p["each"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("spec_id"), batch.column("doc_id"), batch.column("piece"), batch.column("tokens"), pa.array(container)],
                names=["spec_id", "doc_id", "piece", "tokens", "container"],
            )

    return run


def fill(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, doc_id, piece, tokens, container): every document's place in the containers of each spec.

    ``sizes`` has doc_id and n_tokens, ``specs`` spec_id and capacity (a fixed
    small table; null, repeated and non-positive capacities are left out).
    Piece p of a document that exceeds the capacity begins at token p * capacity;
    a document that doesn't is piece 0 alone. Documents without tokens need no
    place and give no row; a repeated doc_id counts once.
    """
    spark = sizes.sparkSession
    caps = {int(r[0]): int(r[1]) for r in specs.select("spec_id", "capacity").distinct().collect() if r[0] is not None and r[1] and r[1] > 0}
    sizes = materialise(sizes.select("doc_id", "n_tokens").dropDuplicates(["doc_id"]).filter("n_tokens > 0"))
    caps_df = spark.createDataFrame(sorted(caps.items()), "spec_id int, capacity long")
    per = sizes.groupBy("n_tokens").agg(F.count("*").alias("n")).crossJoin(F.broadcast(caps_df))
    piece_lengths = F.array(
        F.struct(F.col("capacity").alias("tokens"), (F.col("n") * F.floor(F.col("n_tokens") / F.col("capacity"))).alias("n")),
        F.struct((F.col("n_tokens") % F.col("capacity")).alias("tokens"), F.col("n").alias("n")),
    )
    by_length = per.select("spec_id", F.inline(piece_lengths)).filter("tokens > 0 and n > 0").groupBy("spec_id", "tokens").agg(F.sum("n").alias("n")).collect()
    plans = {}
    for s, cap in caps.items():
        counts = np.zeros(cap + 1, np.int64)
        for r in by_length:
            if r[0] == s:
                counts[int(r[1])] += int(r[2])
        plans[s] = _demands(plan(counts), cap)
    salts = max(1, max((int(r[2]) for r in by_length), default=0) // SALTED)
    last = F.floor((F.col("n_tokens") - 1) / F.col("capacity"))
    pieces = sizes.crossJoin(F.broadcast(caps_df)).select("spec_id", "doc_id", "n_tokens", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    items = pieces.select(
        "spec_id", "doc_id", "piece", F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).alias("salt")
    )
    key = ["spec_id", "tokens", "salt"]
    before = Window.partitionBy("spec_id", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = items.withColumn("within", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece")))
    numbered = numbered.join(offsets, key).select("spec_id", "doc_id", "piece", "tokens", (F.col("offset") + F.col("within") - 1).alias("number"))
    return numbered.mapInArrow(_assign(plans), "spec_id int, doc_id long, piece long, tokens long, container long")


def usage(filled: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, containers, fullest, tokens, fill): how full each spec's containers are on average."""
    each = filled.groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"))
    total = each.groupBy("spec_id").agg(F.count("*").alias("containers"), F.max("tokens").alias("fullest"), F.sum("tokens").alias("tokens"))
    caps = specs.select("spec_id", F.col("capacity").cast("long").alias("capacity")).distinct()
    return total.join(F.broadcast(caps), "spec_id").select("spec_id", "capacity", "containers", "fullest", "tokens", F.round(F.col("tokens") / F.col("containers") / F.col("capacity"), 6).alias("fill"))
