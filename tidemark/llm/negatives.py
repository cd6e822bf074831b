"""Hard-negative mining by exact inner products, scored with the Four-Russians table method.

Components become integers, and eight dimensions form a group. For each anchor and group a table holds the sums of all 256 subsets
of the anchor's eight components. A candidate is packed into bit planes: for each plane and group one byte has that bit of its
eight components (two's complement, so the top plane counts negatively). Its inner product with the anchor is then the sum over planes of 2^plane
times the table entries that the plane's bytes select: lookups, shifts and additions only, and exact.

Anchors are the stated query set: they are taken in blocks of bounded size that are broadcast, and every block meets all candidates where
those lie. Two passes are made: the first finds each anchor's positives, the second the negatives inside each positive's score
margin. A task keeps only the best of each anchor it has met, so what is shuffled is a few rows for each anchor and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.workspace import materialise

#: Components of a group, and so bits of a table's index.
GROUP = 8

#: Components of all anchors of a block; with 64 dimensions, 4,096 anchors are broadcast at once (2 MB).
BLOCK_COMPONENTS = 1 << 18

#: Candidates scored at once, and anchors whose tables a task holds at once.
CANDIDATES, TABLES = 8_192, 32

#: What stands for a null id while rows are ranked: it comes last.
NO_ID = np.iinfo(np.int64).max


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, q (array<long>): rows that take part, components as floor(256 x); equal rows once are enough.

    Rows without label or vector, or with a null or non-finite component, are left out.
    """
    x, finite = F.col(vector_col).cast("array<double>"), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * 256)).alias("q"))


def planes(q: np.ndarray) -> np.ndarray:
    """Bit planes of ``q`` (rows x dimensions): bytes (planes x groups x rows); the last plane is the sign's."""
    rows, dims = q.shape
    groups = -(-dims // GROUP)
    padded = np.zeros((rows, groups * GROUP), np.int64)
    padded[:, :dims] = q
    span = int(max(padded.max(initial=0), ~padded.min(initial=0)))
    count = span.bit_length() + 1
    packed = [np.packbits((padded >> min(b, 63)).astype(np.uint8) & 1, axis=1, bitorder="little") for b in range(count)]
    return np.stack([np.ascontiguousarray(p.T) for p in packed])


def tables(anchors: np.ndarray) -> np.ndarray:
    """Sums of all subsets of each eight components (groups x 256 x anchors): each bit doubles the table."""
    n, dims = anchors.shape
    groups = -(-dims // GROUP)
    padded = np.zeros((groups * GROUP, n), np.int64)
    padded[:dims] = anchors.T
    parts = padded.reshape(groups, GROUP, n)
    sums = np.zeros((groups, 1, n), np.int64)
    for bit in range(GROUP):
        sums = np.concatenate([sums, sums + parts[:, bit : bit + 1]], axis=1)
    return sums


def scores(packed: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Inner products (candidates x anchors) by lookups: planes from the top down, doubling what has been summed so far.

    32-bit sums are taken where no partial sum can exceed them; otherwise 64-bit ones, which wrap like Spark's long.
    """
    count, groups, rows = packed.shape
    largest = float(np.abs(sums).max(axis=1).max(axis=1).astype(float).sum()) if sums.size else 0.0
    kind = np.int32 if largest * 2.0**count < 2.0**31 else np.int64
    sums, total = sums.astype(kind), np.zeros((rows, sums.shape[2]), kind)
    for plane in range(count - 1, -1, -1):
        total += total
        for g in range(min(groups, len(sums))):
            found = sums[g].take(packed[plane, g], axis=0)
            total = total - found if plane == count - 1 else np.add(total, found, out=total)
    return total


def _matrix(q: pa.ListArray) -> np.ndarray:
    """Vectors as one matrix; short ones are filled with zeros."""
    lengths, flat = q.value_lengths().to_numpy(zero_copy_only=False), q.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best, higher scores and then smaller ids first; equal pairs of score and id count once."""
    at = np.arange(len(score))
    if len(at) > 4 * n:  # all that may be among them, ties at the end included; repeats may ask for more
        least = np.partition(score, len(score) - n)[len(score) - n]
        at = np.flatnonzero(score >= least)
        if len(np.unique(ids[at])) < n:
            at = np.arange(len(score))
    order = at[np.lexsort((ids[at], -score[at]))]
    same = (score[order[1:]] == score[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]])
    return order[np.concatenate([[True], ~same])][:n] if len(order) else order


class Anchors:
    """One block of anchors: keys, ids, labels, components, and for the second pass each anchor's positives with their scores."""

    def __init__(self, rows: list[Row]):
        rows = sorted(rows, key=lambda r: (r.label, r.anchor))
        self.row, self.ids, self.labels = (np.array([r[c] for r in rows], np.int64) for c in ("anchor", "vec_id", "label"))
        self.q = np.zeros((len(rows), max((len(r.q) for r in rows), default=0)), np.int64)
        for i, r in enumerate(rows):
            self.q[i, : len(r.q)] = r.q
        self.positives = [[tuple(p) for p in (r["positives"] if "positives" in r else None) or []] for r in rows]

    def by_label(self) -> Iterator[tuple[int, list[slice]]]:
        """Each label with its anchors, at most ``TABLES`` at once."""
        begins = [0, *np.flatnonzero(np.diff(self.labels)) + 1] if len(self.labels) else []
        for begin, end in zip(begins, [*begins[1:], len(self.labels)], strict=False):
            yield self.labels[begin], [slice(at, min(end, at + TABLES)) for at in range(begin, end, TABLES)]


class Kept:
    """The best few (score, id) of each key that a task has met."""

    def __init__(self, n: int):
        self.n, self.found = n, {}

    def add(self, key: tuple, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score):
            if key in self.found:
                score, ids = (np.concatenate(x) for x in zip(self.found[key], (score, ids), strict=True))
            at = best(score, ids, self.n)
            self.found[key] = (score[at], ids[at])


def _positives(block: Anchors, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, kept: Kept) -> None:
    for label, runs in block.by_label():
        rows = np.flatnonzero(labels == label)
        for at in range(0, len(rows), CANDIDATES):
            packed, own = planes(q[rows[at : at + CANDIDATES]]), ids[rows[at : at + CANDIDATES]]
            for run in runs:
                found = scores(packed, tables(block.q[run]))
                for j, a in enumerate(range(run.start, run.stop)):
                    other = own != block.ids[a]
                    kept.add((block.row[a],), found[other, j].astype(np.int64), own[other])


def _negatives(block: Anchors, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, kept: Kept, low: int, high: int) -> None:
    for at in range(0, len(q), CANDIDATES):
        part = slice(at, at + CANDIDATES)
        packed, own, own_labels = planes(q[part]), ids[part], labels[part]
        for label, runs in block.by_label():
            other = own_labels != label
            there, bits = own[other], packed[:, :, other]
            for run in runs if len(there) else []:
                found = scores(bits, tables(block.q[run]))
                for j, a in enumerate(range(run.start, run.stop)):
                    column = found[:, j].astype(np.int64)
                    foreign = there != block.ids[a]
                    for positive, score in block.positives[a]:
                        # low * score <= 100 * t <= high * score, in exact integers
                        least, most = -(-low * score // 100), high * score // 100
                        if least <= most:
                            inside = np.flatnonzero((column >= least) & (column <= most) & foreign)
                            kept.add((block.row[a], positive, score), column[inside], there[inside])


KEYS = {"positives": "anchor long", "negatives": "anchor long, positive_id long, positive_score long"}


def _pass(candidates: DataFrame, block: DataFrame, what: str, n: int, low: int = 0, high: int = 0) -> DataFrame:
    """The block's anchors against all candidates: keys, id, score of the best of each task."""
    anchors = candidates.sparkSession.sparkContext.broadcast(Anchors(block.collect()))
    names = [c.split()[0] for c in KEYS[what].split(", ")]

    def run(batches):
        kept = Kept(n)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            labels, q = batch.column(1).to_numpy(), _matrix(batch.column(2))
            if what == "positives":
                _positives(anchors.value, q, ids, labels, kept)
            else:
                _negatives(anchors.value, q, ids, labels, kept, low, high)
        rows = [(*key, int(i), int(s)) for key, (score, own) in kept.found.items() for s, i in zip(score, own, strict=True)]
        for at in range(0, len(rows), 10_000):
            columns = list(zip(*rows[at : at + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*names, "id", "score"])

    return candidates.select("vec_id", "label", "q").mapInArrow(run, KEYS[what] + ", id long, score long")


def _ranked(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The best ``n`` of each key over all tasks, with their rank; equal pairs of id and score count once."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= n).distinct()


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of each anchor and positive: rows of another label with ``low``..``high`` percent of the positive's score.

    ``rows``: vec_id, label, q as of ``vectors``; ``is_anchor``: which of them are anchors. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. Higher scores come first, then smaller ids, null ids last. Rows that share an anchor's vec_id are not its
    positives; candidates with the same id and the same score count once; equal anchor rows are one anchor, different rows of one id are several.
    Vectors may differ in length: missing components are zero. Beyond 64 bits components saturate and scores wrap as
    Spark's long does. A null id is never an anchor. An empty table, or no anchor, gives no rows.
    """
    candidates = materialise(rows.select("vec_id", "label", "q"), "candidates")
    chosen = candidates.where(is_anchor & F.col("vec_id").isNotNull()).distinct()
    chosen = materialise(chosen.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    count, width = chosen.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    blocks = max(1, -(-count * max(1, width) // BLOCK_COMPONENTS))
    in_block = F.pmod(F.xxhash64("anchor"), F.lit(blocks))
    out = None
    for number in range(blocks):
        block = chosen.where(in_block == number)
        near = _ranked(_pass(candidates, block, "positives", positives), ["anchor"], positives)
        near = near.groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
        armed = block.join(near, "anchor", "left")
        found = _pass(candidates, armed, "negatives", negatives, low, high)
        ranked = _ranked(found, ["anchor", "positive_id", "positive_score"], negatives)
        ranked = ranked.join(F.broadcast(block.select("anchor", F.col("vec_id").alias("anchor_id"))), "anchor")
        ranked = materialise(ranked, "negatives") if blocks > 1 else ranked
        out = ranked if out is None else out.unionByName(ranked)

    def known(c: str) -> Column:
        return F.when(F.col(c) != int(NO_ID), F.col(c))

    return out.select("anchor_id", known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
