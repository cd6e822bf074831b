"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints have 64 bits and link at ``MOST`` = 2 or fewer differing bits. Cut into two segments of 32 bits, two linked
fingerprints differ by at most one bit in at least one segment. Each segment is indexed under its 32 variants with one bit
wildcarded; segments that differ by at most one bit share a variant, so an equality join finds every link, and the whole
fingerprints verify it. Only distinct fingerprints are joined; copies follow their fingerprint.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, broadcast_if_small
from tidemark.llm.components import connected_components
from tidemark.workspace import materialise

MOST, SEGMENTS, SEGMENT_BITS, SEED = 2, 2, 32, 42

#: Blocks of more distinct fingerprints than this are not paired off but refined by the other segment's variants.
LARGE_BLOCK = 2_000


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of some 64-bit hashes as a signed integer: a bit is 1 if it is set in over half of them."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536]
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hashes of the ``words``-word shingles of ``text`` with A-Z lower-cased, one of all words where they are fewer; none where there is no word."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of the ``words``-word shingles of ``text``; 0 where there is no word."""
    hashes = shingle_hashes(text, words)
    return majority(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, row (a hash of id and text), fp for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), row_hash(docs, id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_py(), words) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "row", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, row long, fp long")


def row_hash(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col], docs[text_col])


def _segment(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * segment).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _variants(fp: Column, segment: int) -> list[Column]:
    """The segment with each of its bits wildcarded in turn; the wildcard's place and the segment are part of the key."""
    value = _segment(fp, segment)
    return [value.bitwiseAND(F.lit(~(1 << bit))) + F.lit((segment << 38) | (bit << 32)) for bit in range(SEGMENT_BITS)]


def links(distinct_fps: DataFrame, large_block: int = LARGE_BLOCK) -> DataFrame:
    """u, v: links between the fingerprints of ``distinct_fps`` (column fp) that connect what links at MOST bits connect.

    Blocks of up to ``large_block`` fingerprints give each of their links once. In a larger block, members already agree on the
    segment but for one bit, so each gets the variants of the other segment as well, and what shares such a variant
    differs by two bits at most: linking it to its least member loses no connection and makes no pairs.
    """
    fp = F.col("fp")
    indexed = distinct_fps.select(F.explode(F.array(*[k for s in range(SEGMENTS) for k in _variants(fp, s)])).alias("key"), fp)
    blocks = materialise(indexed.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("members > 1"), "blocks")

    small = blocks.where(F.col("members") <= large_block)
    left, right = small.select("key", F.col("fp").alias("u")), small.select("key", F.col("fp").alias("v"))
    differ, first = F.col("u").bitwiseXOR(F.col("v")), F.shiftright("key", 38) == 0
    here = F.when(first, _segment(differ, 0)).otherwise(_segment(differ, 1))
    once = ((here != 0) | (F.shiftright("key", 32).bitwiseAND(F.lit(31)) == 0)) & (first | (F.bit_count(_segment(differ, 0)) > 1))
    pairs = left.join(right, "key").where((F.col("u") > F.col("v")) & (F.bit_count(differ) <= MOST) & once).select("u", "v")

    large = blocks.where(F.col("members") > large_block)
    in_first = F.shiftright("key", 38) == 0
    other = [F.when(in_first, b).otherwise(a) for a, b in zip(_variants(fp, 0), _variants(fp, 1), strict=True)]
    refined = large.select("key", fp, F.explode(F.array(*other)).alias("finer"))
    stars = refined.join(refined.groupBy("key", "finer").agg(F.min("fp").alias("least")), ["key", "finer"])
    stars = stars.where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    # Two bits in one segment and none in the other: the other segment's own blocks hold that pair under every variant.
    value = F.when(in_first, _segment(fp, 1)).otherwise(_segment(fp, 0))
    bits = F.array(*[F.lit(1 << b) for b in range(SEGMENT_BITS)])
    twice = F.flatten(F.transform(bits, lambda a: F.transform(F.filter(bits, lambda b: b > a), lambda b: F.struct(a.bitwiseOR(b).alias("holes"), value.bitwiseAND(F.bitwise_not(a.bitwiseOR(b))).alias("value")))))
    doubled = large.where(F.shiftright("key", 32).bitwiseAND(F.lit(63)) == 0).select("key", fp, _segment(fp, 0).alias("s0"), _segment(fp, 1).alias("s1"), F.explode(twice).alias("finer"))
    same = F.when(in_first, F.col("s0")).otherwise(F.col("s1"))
    doubled = doubled.select("key", same.alias("same"), "finer.holes", "finer.value", "fp")
    stars2 = doubled.join(doubled.groupBy("key", "same", "holes", "value").agg(F.min("fp").alias("least")), ["key", "same", "holes", "value"])
    stars2 = stars2.where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    return pairs.unionByName(stars).unionByName(stars2)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, large_block: int = LARGE_BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, row, fp, component_id (the smallest doc_id reachable over links, itself included).

    Null, empty and blank texts have fingerprint zero and link like any other. Rows that repeat an id are each returned.
    A component whose ids are all null has a null component_id. Other columns are ignored; an empty table gives no rows.
    """
    with arrow_batches(docs.sparkSession):
        prints = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    groups = materialise(connected_components(links(distinct.select("fp"), large_block)), "groups")
    member = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = materialise(member.join(least, "component").select(F.col("fp").alias("of"), "component_id"), "component-ids")
    return prints.join(ids, prints["fp"] == ids["of"]).select("doc_id", "row", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those of a component whose id is not its smallest (a null id: unless all are null)."""
    found = near_duplicates(docs, id_col, text_col)
    return without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), id_col, text_col)


def without(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without those ``rows`` (doc_id, row: a hash of id and text)."""
    gone = materialise(rows.select(F.col("row").alias("gone"), F.col("doc_id").alias("gone_id")).distinct(), "removed-rows")
    return docs.join(broadcast_if_small(gone), (row_hash(docs, id_col, text_col) == gone["gone"]) & docs[id_col].eqNullSafe(gone["gone_id"]), "left_anti")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
