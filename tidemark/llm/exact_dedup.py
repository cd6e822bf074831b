"""Exact deduplication that keeps heavy hitters out of the shuffle.

Texts are compared by the SHA-256 of their normalised form. Misra-Gries counters (Spark's ``freqItems``) name the few
digests that may hold more than ``support`` of all rows; an exact count of only those verifies them, and the verified
winners, at most 1/support rows, are broadcast so that their copies are resolved where they are read. All other digests,
none of which can hold more than ``support`` of the rows, take an ordinary hash shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii
from tidemark.workspace import materialise


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.002) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised text the one with the largest id stays. Null text counts as empty. Rows that repeat an id
    within a group are one document: all of them carry the same decision. A null id is kept only where its group has no
    other id (keep_id is null then). Other columns of ``docs`` are ignored, an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), F.sha2(lower_ascii(text), 256).alias("text_sha256")), "digests")
    group = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]

    candidates = digests.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    heavy_from = max(2, math.ceil(support * digests.count()))
    counted = digests.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(*group)
    winners = materialise(counted.where(F.col("group_size") >= heavy_from), "heavy-digests")

    heavy = digests.join(F.broadcast(winners), "text_sha256")
    light = digests.join(F.broadcast(winners), "text_sha256", "left_anti")
    by_digest = Window.partitionBy("text_sha256")
    light = light.select("text_sha256", "doc_id", *(c.over(by_digest) for c in (F.max("doc_id"), F.count(F.lit(1))))).toDF("text_sha256", "doc_id", "keep_id", "group_size")
    both = heavy.unionByName(light)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
