"""URL filters: authored host and path rules first, mined association rules for what they leave open.

Labelled URLs become sets of tokens (host labels, path segments, query names). Tokens that stand in the very same labelled
URLs are one class, so that a template of many tokens is one item and not an exponential number of combinations. Spark's
FP-growth finds the combinations of classes that occur often enough; those whose chance of being blocked is surely high
enough become rules. Rules are matched by an inverted index: a rule is listed under its rarest class, looked up by the
classes of each distinct token set, and then verified. A set has a class if it has any of its tokens: every part of a class
has the rows, and so the rules, of the whole.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import broadcast_if_small, lower_ascii
from tidemark.workspace import materialise

#: Least share of labelled URLs that hold a mined combination and are blocked; least share of its URLs that are blocked, as
#: the lower end of Wilson's interval of so many standard deviations, so that few rows earn no rule by chance.
SUPPORT, CONFIDENCE, DEVIATIONS = 0.002, 0.8, 1.645

#: (verdict, host, path): fits the host and its subdomains where the path begins so; the longest that fits decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

BLOCKED = "=block"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Sorted distinct tokens: ``h:`` host labels, ``p:`` path segments, ``q:`` query names; digits become ``#``."""
    def tagged(tag: str, parts: Column) -> Column:
        filled = F.filter(parts, lambda x: x != "")
        return F.transform(filled, lambda x: F.concat(F.lit(tag), F.regexp_replace(x, "[0-9]+", "#")))

    query = F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    all_of = F.concat(tagged("h:", F.split(host(url), r"\.")), tagged("p:", F.split(path(url), "/")), tagged("q:", names))
    return F.array_sort(F.array_distinct(all_of))


def decide(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest authored rule that fits, host and path together; null where none does."""
    def fits(h: str, p: str) -> Column:
        return ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)

    none = F.lit(None).cast("string")
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = F.coalesce(none, *(F.when(fits(h, p), F.lit(h + p)) for _, h, p in longest))
    verdict = F.coalesce(none, *(F.when(fits(h, p), F.lit(v)) for v, h, p in longest))
    return rule, verdict


def surely(share: Column, rows: Column, z: float = DEVIATIONS) -> Column:
    """The lower end of Wilson's interval for a share that was seen in so many rows."""
    return (share + z * z / (2 * rows) - z * F.sqrt(share * (1 - share) / rows + z * z / (4 * rows * rows))) / (1 + z * z / rows)


def token_classes(baskets: DataFrame, least: float) -> DataFrame:
    """token, item: the tokens of at least ``least`` rows of ``baskets`` (row, tokens); those of the same rows share an item."""
    of = ["n", "rows", "again"]
    same_rows = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("rows"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("again"))
    often = baskets.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(*same_rows).where(F.col("n") >= least)
    often = materialise(often, "url-tokens")
    return materialise(often.join(often.groupBy(of).agg(F.min("token").alias("item")), of).select("token", "item"), "url-classes")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(rules, classes). rules: items (array), rarest, confidence of combinations that go with blocking; classes: token, item.

    ``labelled``: tokens, blocked. Rows with a null label or without tokens are left out; none left give no rules.
    """
    spark = labelled.sparkSession
    usable = labelled.where(F.col("blocked").isNotNull() & (F.size("tokens") > 0))
    baskets = materialise(usable.select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"), "baskets")
    total = baskets.count()
    classes = token_classes(baskets, support * total)
    exploded = baskets.select("row", "blocked", F.explode("tokens").alias("token")).join(broadcast_if_small(classes), "token", "left")
    items = exploded.groupBy("row", "blocked").agg(F.collect_set("item").alias("items"))
    items = items.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(BLOCKED)))).otherwise(F.col("items")).alias("items"))
    items = materialise(items, "item-sets")
    if not total:
        return spark.createDataFrame([], T.StructType.fromDDL("items array<string>, rarest string, confidence double")), classes
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
    sure = surely(F.col("confidence"), F.col("support") * total / F.col("confidence")) >= confidence
    rules = found.where((F.col("consequent")[0] == BLOCKED) & sure).select(F.array_sort("antecedent").alias("items"), "confidence")
    rules = materialise(rules, "rules")
    how_often = items.select(F.explode("items").alias("item")).groupBy("item").count()
    listed = rules.select("items", "confidence", F.explode("items").alias("item")).join(how_often, "item")
    index = listed.groupBy("items").agg(F.min_by("item", F.struct("count", "item")).alias("rarest"), F.first("confidence").alias("confidence"))
    return materialise(index, "rule-index"), classes


def matching(sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct token sets of ``sets`` (column tokens) that have all items of some rule."""
    tokens_of = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    having = tokens_of.join(broadcast_if_small(classes), "token").groupBy("tokens").agg(F.collect_set("item").alias("having"))
    index = broadcast_if_small(rules.select("items", F.col("rarest").alias("item")))
    looked_up = having.select("tokens", "having", F.explode("having").alias("item")).join(index, "item")
    return looked_up.where(F.size(F.array_except("items", "having")) == 0).select("tokens").distinct()


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block).

    Of the URLs that no authored rule decides, those whose path has the number of a labelled document are labelled: blocked
    where it is of low quality or toxic, by any of its labels. The mined rules
    block what they match, anything else is allowed. A null URL has no tokens and is allowed; repeated rows are each
    returned, other columns are ignored, empty tables give empty results.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parsed = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.coalesce(tokens(F.col("url")), F.array().cast("array<string>")).alias("tokens"))
    rule, ruled = decide(F.col("host"), F.col("path"), rules)
    number = F.try_to_number(F.regexp_extract("path", "/([0-9]{1,18})(?![0-9])", 1), F.lit("9" * 18)).cast("long")
    parsed = materialise(parsed.select("*", rule.alias("rule"), ruled.alias("ruled"), number.alias("number")), "urls")
    known = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    # Only what no authored rule decides is to be judged by mined rules, so only its labels are learned from.
    labelled = parsed.where("ruled is null").join(known, F.col("number") == F.col("of")).select("tokens", F.col("bad").alias("blocked"))
    matched = materialise(matching(parsed.where("ruled is null"), *mine(labelled, support, confidence)), "matched").withColumn("hit", F.lit(True))
    judged = parsed.join(broadcast_if_small(matched), "tokens", "left")
    verdict = F.coalesce("ruled", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
