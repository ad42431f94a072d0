"""Problem 1: lines that one source repeats across its documents.

Each source's documents are sequences of line identifiers. Their suffixes are
sorted (a range-partitioned suffix array), neighbouring suffixes give common
prefixes, and every common prefix is a repeated block of one or more lines. The
blocks that span enough documents of the source are deleted.

Suffixes are compared over DEPTH lines first; those that still tie with enough
others at that depth are sorted again over twice as many, until none is left, so
a block is found whole whatever its length.

Scale: a suffix whose first line is in fewer than the least number of documents
can't begin a block, so the array holds only the other suffixes; whether a block
is in the required share of its source's documents is counted on the blocks. The
sort key ends in the document, so a line that a third of the rows carry still
spreads over many tasks. Documents of a block are counted by a distinct and a
partial aggregation, and joins with hot lines or blocks are salted, or broadcast
after their rows were counted. The array is written once for each depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.operators.skew import counted_join, spread_join
from bidloom.session import materialise

#: Lines of a suffix that are compared first.
DEPTH = 8
MIN_DOCS = 3
MIN_SHARE = 0.2


def line_key(line):
    """The letters of a line, lower-cased; '' if it has none."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def source_lines(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, doc_id, para_id, para_index, line_no, line): lines with letters; ``line`` is the 64-bit id of the line's letters.

    A collision of ids matters only if it joins a rare line to one of the few
    that span a fifth of their source, about 2**-57 for each rare line.
    Null texts have no lines. Documents of no source form a source of their own.
    """
    lines = (
        paragraphs.select("doc_id", "para_id", "para_index", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
        .select("doc_id", "para_id", "para_index", "line_no", line_key(F.col("raw")).alias("letters"))
        .filter(F.col("letters") != "")
        .select("doc_id", "para_id", "para_index", "line_no", F.xxhash64("letters").alias("line"))
    )
    return lines.join(document_sources(documents), "doc_id")


def document_sources(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).dropDuplicates(["doc_id"])


def _prefixes(depth: int, known: int):
    """Of a sorted stretch of the suffix array: each suffix with each prefix of more than ``known`` lines it shares with a neighbour.

    At the ends of a partition the neighbour isn't seen, so all prefixes of that
    suffix are given; counting the documents of each block decides in the end.
    """

    def emit(rows: dict, lcp: np.ndarray) -> pa.RecordBatch:
        more = np.maximum(lcp - known, 0)
        start = np.repeat(np.arange(len(more)), more)
        size = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1 + known
        at = pa.array(start)
        columns = {n: rows["batch"].column(n).take(at) for n in ("source", "doc_id", "para_id", "line_no", "pos")}
        columns |= {"size": pa.array(size, pa.int32()), "block": pa.array(rows["hashes"][start, size - 1], pa.int64())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def common(a: dict, i: int, b: dict, j: int) -> int:
        if a["source"][i] != b["source"][j]:
            return 0
        return int(np.argmin(np.append((a["lines"][i] == b["lines"][j]) & (a["lines"][i] != 0), False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        before = None  # common prefix of the held batch's last suffix with the next batch's first
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch, depth)
            if held is not None:
                after = common(held, held["n"] - 1, rows, 0)
                yield emit(held, _lcps(held, before, after))
                before = after
            held = rows
        if held is not None:
            yield emit(held, _lcps(held, before, None))

    return run


def _matrix(batch: pa.RecordBatch, depth: int) -> dict:
    suffix = batch.column("suffix")
    n = batch.num_rows
    offsets = suffix.offsets.to_numpy()
    flat = suffix.values.to_numpy(zero_copy_only=False)
    lines = np.zeros((n, depth), np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    lines[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat[offsets[0] : offsets[-1]]
    hashes = np.zeros((n, depth), np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.int64)
        for k in range(depth):
            h = (h ^ lines[:, k]) * np.int64(-7046029254386353131) + np.int64(k + 1)
            h ^= (h >> np.int64(29)) & np.int64((1 << 35) - 1)
            hashes[:, k] = h
    return {
        "n": n,
        "batch": batch,
        "source": batch.column("source").to_pylist(),
        "lines": lines,
        "sizes": sizes,
        "hashes": hashes,
    }


def _lcps(rows: dict, before: int | None, after: int | None) -> np.ndarray:
    n, lines, sizes = rows["n"], rows["lines"], rows["sizes"]
    same = (lines[1:] == lines[:-1]) & (lines[1:] != 0)
    source = np.asarray(rows["source"], dtype=object)
    inner = np.where(source[1:] == source[:-1], np.cumprod(same, axis=1).sum(axis=1), 0)
    left = np.concatenate([[sizes[0] if before is None else before], inner])
    right = np.concatenate([inner, [sizes[-1] if after is None else after]])
    return np.minimum(np.maximum(left, right), sizes).astype(np.int64) if n else left


def _frequent(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines found in ``min_docs`` documents of their source, with their place in the document and the run of such lines they are in.

    A line of a repeated row is the same line again and counts once.
    """
    first = lines.select("source", "line", "doc_id").distinct().groupBy("source", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    marked = spread_join(lines, first.select("source", "line", F.lit(True).alias("often")), ["source", "line"], ["doc_id", "para_id", "line_no"], "left")
    order = Window.partitionBy("doc_id").orderBy("para_index", "para_id", "line_no")
    again = F.lag("para_id").over(order).eqNullSafe(F.col("para_id")) & F.lag("line_no").over(order).eqNullSafe(F.col("line_no"))
    placed = marked.withColumn("again", again).filter("not again").withColumn("pos", F.row_number().over(order)).filter("often")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return placed.select("source", "doc_id", "para_id", "line_no", "line", "pos", run.alias("run"))


def repeated_blocks(paragraphs: DataFrame, documents: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, block, para_id, line_no, size, docs): each line that begins a block of ``size`` lines found in ``docs`` documents of its source.

    A block counts if it is in at least ``min_docs`` documents and in at least
    ``min_share`` of the source's documents with paragraphs. A line has a row for
    every size of block that begins at it. Repeated rows count once.
    """
    total = paragraphs.select("doc_id").distinct().join(document_sources(documents), "doc_id").groupBy("source").agg(F.count("*").alias("total"))
    need = materialise(total.select("source", F.greatest(F.lit(min_docs).cast("double"), F.ceil(F.col("total") * min_share - 1e-9).cast("double")).alias("need")))
    frequent = materialise(_frequent(source_lines(paragraphs, documents), min_docs))
    begins, known, depth, out = None, 0, DEPTH, None
    while True:
        ahead = Window.partitionBy("doc_id", "run").orderBy("pos").rowsBetween(0, depth - 1)
        suffixes = frequent.select("source", "doc_id", "para_id", "line_no", "pos", F.collect_list("line").over(ahead).alias("suffix"))
        if begins is not None:
            suffixes = suffixes.join(begins, ["doc_id", "pos"], "left_semi")
        key = ["source", "suffix", "doc_id", "pos"]
        array = suffixes.repartitionByRange(*key).sortWithinPartitions(*key)
        prefixes = materialise(array.mapInArrow(_prefixes(depth, known), "source string, doc_id long, para_id long, line_no int, pos int, size int, block long"))
        blocks = prefixes.select("source", "size", "block", "doc_id").distinct().groupBy("source", "size", "block").agg(F.count("*").alias("docs"))
        blocks = materialise(blocks.join(need, "source").filter(F.col("docs") >= F.col("need")).drop("need"))
        here = counted_join(prefixes, blocks, ["source", "size", "block"], ["para_id", "line_no"])
        now = here.select("source", "block", "para_id", "line_no", "size", "docs")
        out = now if out is None else out.union(now)
        if not blocks.filter(F.col("size") == depth).head(1):
            return out
        begins = materialise(here.filter(F.col("size") == depth).select("doc_id", "pos").distinct())
        known, depth = depth, 2 * depth


def found(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """(para_id, line_no) of every line to delete.

    Each line of a longer block begins a block of its own with at least as many
    documents, so the lines that begin a block are all lines of all blocks.
    """
    return repeated_blocks(paragraphs, documents).select("para_id", "line_no").distinct()


def blocks_report(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, size, blocks, docs_max): how many different blocks of each number of lines each source has, and the most documents one is in."""
    each = repeated_blocks(paragraphs, documents).groupBy("source", "size", "block").agg(F.max("docs").alias("docs"))
    return each.groupBy("source", "size").agg(F.count("*").alias("blocks"), F.max("docs").alias("docs_max"))


def cleaned(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """(para_id, doc_id, text, lines_removed): each paragraph without its source's repeated lines.

    A null text stays null; a text all of whose lines go becomes ''.
    """
    gone = found(paragraphs, documents).groupBy("para_id").agg(F.collect_set("line_no").alias("gone"))
    texts = paragraphs.select("para_id", "doc_id", "text").dropDuplicates(["para_id"])
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return texts.join(gone, "para_id", "left").select(
        "para_id",
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("lines_removed"),
    )
