"""Mix sources to target weights by hash thresholds, without sorting documents.

Each document has a 60-bit hash. A source's budget becomes a threshold on that hash: documents below it are taken once
more than those above. The threshold is found from a histogram of words by source and leading hash bits; only the bucket
on the boundary is read again, by its next bits, until it is one hash value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, broadcast_if_small
from tidemark.workspace import materialise

HASH_BITS, STEP_BITS = 60, 12
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of ``key`` as text (null: empty), as a long."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target: ``share`` of all words dealt by weight, no source above ``most`` times its size.

    Sources take the weights in turn by code point, null last. Capped sources' excess goes to the others by weight until
    none is above its cap: with sources ordered by cap over weight, the first that stays below sets the level of the rest.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy(F.col("source").isNull(), "source"), Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - before) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    shared = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    target = F.when(F.col("open"), shared * F.col("weight")).otherwise(F.col("cap")).cast("double")
    return filled.select("source", "source_size", target.alias("target"))


def hash_thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: the documents of the source whose hash is below it hold the words nearest to its budget.

    ``budgets`` has source, budget (words, at most what the source has). Documents with one and the same hash go together.
    """
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"))
    done, rows = None, sizes
    for low in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        bounds = broadcast_if_small(state.select(F.col("source").alias("of"), "prefix"))
        inside = rows.join(bounds, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", low + STEP_BITS) == F.col("prefix")), "left_semi")
        if low + STEP_BITS < HASH_BITS:
            rows = inside = materialise(inside, "boundary")
        histogram = inside.groupBy("source", F.shiftright("hash", low).alias("bucket")).agg(F.sum("size").alias("words"))
        joined = histogram.join(state.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
        upto = Window.partitionBy("source").orderBy("bucket")
        joined = joined.withColumn("end", F.sum("words").over(upto)).where(F.col("end") > F.col("rest"))
        first = joined.withColumn("nth", F.row_number().over(upto)).where("nth = 1")
        state = materialise(first.select("source", F.col("bucket").alias("prefix"), (F.col("rest") - F.col("end") + F.col("words")).alias("rest"), "words"), "boundaries")
        done = state
    nearer = F.col("words") - F.col("rest") < F.col("rest")
    found = done.select(F.col("source").alias("of"), (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))
    whole = F.coalesce("threshold", F.lit(1 << HASH_BITS))
    return budgets.join(found, F.col("source").eqNullSafe(F.col("of")), "left").select("source", whole.alias("threshold"))


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """of (the source), source_size, target, base, threshold: a document of the source is taken ``base`` times, and once more
    if its hash is below ``threshold``. ``sizes``: source, size, hash."""
    targets = materialise(source_targets(sizes, weights, share), "targets")
    once = F.col("target") >= F.col("source_size")
    budgets = targets.select("source", F.when(once, F.col("target") - F.col("source_size")).otherwise(F.col("target")).alias("budget"))
    thresholds = hash_thresholds(sizes, budgets).select(F.col("source").alias("of"), "threshold")
    plan = targets.join(thresholds, F.col("source").eqNullSafe(F.col("of")))
    return materialise(plan.select(F.col("source").alias("of"), "source_size", "target", once.cast("int").alias("base"), "threshold"), "mix-plan")


def copies() -> Column:
    """How often a document is taken, over the columns of a mix plan and the document's hash."""
    return F.col("base") + (F.col("hash") < F.col("threshold")).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken (= size x copies, copies 0 to 2).

    Null text has size 0. A null source is a source of its own, the last. Rows that repeat an id (or have none) hash alike
    and are taken together. A source whose boundary document is large misses its target by at most half that document.
    Other columns are ignored, an empty table gives an empty result. The choice depends on ids and sizes only, so reruns agree.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    mixed = sizes.join(broadcast_if_small(mix_plan(sizes, weights, share)), F.col("source").eqNullSafe(F.col("of")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", copies().alias("copies"), (F.col("size") * copies()).alias("taken"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("hash")), "sizes")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` takes it: not at all, once or twice."""
    plan = broadcast_if_small(mix_plan(_sizes(docs, id_col, text_col, source_col)))
    # Rows travel as one struct, so that no name of theirs can clash.
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(source_col).alias("source"), hash60(F.col(id_col)).alias("hash"))
    taken = whole.join(plan, F.col("source").eqNullSafe(F.col("of"))).where(copies() > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), copies())).alias("copy")).select("doc.*")
