"""Sketches: MinHash, SimHash, their estimates and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import fixed
from bidloom.session import materialise


def hash_slot(token: Column, seed: int) -> Column:
    """The low 32 bits of md5 of ``token:seed``."""
    return F.conv(F.right(F.md5(F.concat(token, F.lit(f":{seed}"))), F.lit(8)), 16, 10).cast("long")


def minhash(tokens: DataFrame, key: str, slots: int = fixed.SLOTS) -> DataFrame:
    """(key, sig): MinHash signatures of the sets of tokens given as (key, token) rows.

    Each distinct token is hashed once, in a table of its own (else the optimiser
    moves the hashing behind the join, to every row); the minima are partial aggregates.
    """
    vocabulary = materialise(tokens.select("token").distinct().select("token", *[hash_slot(F.col("token"), s).alias(f"s{s}") for s in range(slots)]))
    mins = tokens.select(key, "token").distinct().join(vocabulary, "token").groupBy(key).agg(*[F.min(f"s{s}").alias(f"s{s}") for s in range(slots)])
    return mins.select(key, F.array(*[f"s{s}" for s in range(slots)]).alias("sig"))


def merged(sketches: DataFrame, key: str, slots: int = fixed.SLOTS) -> DataFrame:
    """Signatures of unions: the least of each slot over the rows of ``key``."""
    return sketches.groupBy(key).agg(*[F.min(F.col("sig")[s]).alias(f"s{s}") for s in range(slots)]).select(key, F.array(*[f"s{s}" for s in range(slots)]).alias("sig"))


def equal_slots(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))


def simhash(tokens: DataFrame, key: str) -> DataFrame:
    """(key, simhash): 64 bits, each the sign of the weighted sum of the bits of md5 of the tokens, as (key, token, tf) rows."""
    high = F.conv(F.substring(F.md5("token"), 17, 8), 16, 10).cast("long")
    low = F.conv(F.substring(F.md5("token"), 25, 8), 16, 10).cast("long")
    rows = tokens.select(key, F.col("tf").cast("long").alias("tf"), high.alias("high"), low.alias("low"))
    bit = lambda half, b: F.sum(F.when(F.col(half).bitwiseAND(F.lit(1 << b)) != 0, F.col("tf")).otherwise(-F.col("tf")))
    sums = rows.groupBy(key).agg(*[bit(h, b).alias(f"{h}{b}") for h in ("high", "low") for b in range(32)])
    half = lambda h: sum((F.when(F.col(f"{h}{b}") > 0, F.lit(1 << b)).otherwise(0) for b in range(1, 32)), F.when(F.col(f"{h}0") > 0, 1).otherwise(0)).cast("long")
    return sums.select(key, half("high").alias("high"), half("low").alias("low"))


def hamming(a_high: Column, a_low: Column, b_high: Column, b_low: Column) -> Column:
    return F.bit_count(a_high.bitwiseXOR(b_high)) + F.bit_count(a_low.bitwiseXOR(b_low))


def hex_bits(digits: Column) -> Column:
    """A hash of 16 hex digits as a long; null if it is none."""
    ok = digits.rlike("^[0-9a-f]{16}$")
    return F.when(ok, F.shiftleft(F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")))


def _blocks(distance: int) -> tuple[list[int], int]:
    """Bounds of blocks of bits, and how many bits of a block are flipped: with ``distance`` bits spread over the blocks, one has that few."""
    flips = 1 if distance >= 6 else 0
    n = distance // (flips + 1) + 1
    return [round(i * 64 / n) for i in range(n + 1)], flips


def hash_blocks(h: Column, distance: int, flipped: bool = False) -> Column:
    """(block, bits) of a 64-bit hash; with ``flipped`` also those with one bit of the block changed, where the distance asks for it."""
    cuts, flips = _blocks(distance)
    out = []
    for i in range(len(cuts) - 1):
        size = cuts[i + 1] - cuts[i]
        bits = F.shiftrightunsigned(h, cuts[i]).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))
        masks = [0] + ([1 << b for b in range(size)] if flips and flipped else [])
        out += [F.struct(F.lit(i).alias("block"), bits.bitwiseXOR(F.lit(m)).alias("bits")) for m in masks]
    return F.array(*out)


def near_hashes(hashes: DataFrame, key: str, distance: int) -> DataFrame:
    """(hash_a, hash_b, d): all pairs of different hashes (distinct longs in ``key``) at most ``distance`` bits apart.

    Exact: of distance + 1 blocks of bits one is equal, or, from 6 bits on, of half
    as many and wider blocks one differs in a bit at most, which one side tries.
    """
    one = hashes.select(F.col(key).alias("hash_a")).filter("hash_a is not null").distinct()
    a = one.select("hash_a", F.inline(hash_blocks(F.col("hash_a"), distance, True)))
    b = one.select(F.col("hash_a").alias("hash_b"), F.inline(hash_blocks(F.col("hash_a"), distance)))
    d = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    return a.join(b, ["block", "bits"]).filter("hash_a < hash_b").select("hash_a", "hash_b", d.alias("d")).filter(F.col("d") <= distance).distinct()
