"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the list of the most frequent character n-grams of padded words, in order of frequency. A text takes the
language whose profile is nearest by out-of-place distance: for each n-gram of the text's own profile, how far its rank
lies from its rank in the language's, or the profile's length where that lacks it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, broadcast_if_small
from tidemark.workspace import materialise

PROFILE = 400
UNKNOWN = "und"

#: Profiles are sent to every task: PROFILE numbers for each of about so many languages. Where there are more, texts go through several blocks.
MOST_LANGUAGES = 2_000

#: n-grams are counted in blocks of so many characters, and passed on when a task holds so many distinct ones.
BLOCK, HELD = 1 << 20, 200_000

SPACE, CHAR_BITS = 32, 21


@cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of one to three characters of the lower-cased words of ``text``, each padded by a space.

    A word is a run of letters. An n-gram is a number of 21 bits a character, so that numbers sort as the n-grams do.
    """
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[chars]
    starts = letter & ~np.concatenate([[False], letter[:-1]])
    at = np.flatnonzero(letter)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # Each letter moves right by the number of words begun so far, which leaves one space before every word.
    padded = np.full(len(at) + int(starts.sum()) + 1, SPACE, np.uint64)
    padded[np.arange(len(at)) + np.cumsum(starts)[at]] = chars[at]
    found, counts = [], []
    for begin in range(0, len(padded), BLOCK):
        a, b, c = (padded[begin + i : begin + i + BLOCK] for i in range(3))
        one = a[a != SPACE] << np.uint64(2 * CHAR_BITS)
        two = (a[: len(b)] << np.uint64(2 * CHAR_BITS)) | (b << np.uint64(CHAR_BITS))
        three = (two[: len(c)] | c)[b[: len(c)] != SPACE]
        grams, n = np.unique(np.concatenate([one, two, three]), return_counts=True)
        found.append(grams)
        counts.append(n)
    return (found[0], counts[0]) if len(found) == 1 else _added(found, counts)


def _added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(np.concatenate(grams), return_inverse=True)
    return distinct, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def profile(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent of the sorted ``grams``; ties in the order of their code points."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether CRC-32 of the id as text (null: empty) leaves ``fold`` when divided by ``folds``."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


Profiles = list[tuple[str, list[int]]]


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """lang, rank, gram: the profile of each non-null language of ``docs``.

    Every document and whole text counts; null texts and texts without letters add nothing. An empty table gives no profile.
    """

    def count(batches):
        held: dict[str, list] = {}

        def total(lang):
            held[lang] = [_added(*zip(*held[lang], strict=True))]
            return len(held[lang][0][0])

        def flush():
            for lang in held:
                total(lang)
                grams, n = held[lang][0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                held.setdefault(lang.as_py(), []).append(gram_counts(text.as_py()))
                if len(held[lang.as_py()]) > 500:
                    total(lang.as_py())
            if sum(total(lang) for lang in held) > HELD:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return materialise(totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "rank", "gram"), "profiles")


def profile_blocks(top: DataFrame) -> Iterator[Profiles]:
    """(lang, profile) of all languages, in blocks of about MOST_LANGUAGES, each in the order of the languages' code points."""
    blocks = max(1, -(-top.select("lang").distinct().count() // MOST_LANGUAGES))
    for number in range(blocks):
        found: dict[str, list[int]] = {}
        part = top.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == number)
        for lang, _, gram in sorted(part.collect(), key=lambda r: (r["lang"].encode(), r["rank"])):
            found.setdefault(lang, []).append(gram)
        if found or blocks == 1:
            yield list(found.items())


class Predictor:
    """Nearest profile; with equal distances the first language by code point."""

    def __init__(self, profiles: Profiles, size: int = PROFILE):
        self.langs, self.size = [lang for lang, _ in profiles], size
        self.grams = np.unique(np.array([g for _, p in profiles for g in p], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(profiles)), -1, np.int32)  # the last row is for unknown n-grams
        for k, (_, p) in enumerate(profiles):
            self.ranks[np.searchsorted(self.grams, np.array(p, np.uint64)), k] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is 1 less the distance's share of the largest possible one."""
        own = profile(*gram_counts(text), self.size) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != own] = len(self.grams)
        there = self.ranks[at]
        away = np.where(there < 0, self.size, np.abs(there - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def predicted(text: Column, spark, profiles: Profiles) -> Column:
    """struct<lang_pred, score> for ``text``: ``und`` and 0 where it is null or has no letter, or no language is known."""
    shared = spark.sparkContext.broadcast(profiles)
    made: list[Predictor] = []

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Predictor(shared.value))
        return pd.DataFrame([made[0].predict(t) for t in texts], columns=["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1).

    Profiles are learned from documents outside the fold that have a language; language, source and id are no inputs of a
    prediction. Repeated rows are each returned, null ids count as empty text for the fold, other columns are ignored.
    """
    out, spark = held_out(F.col(id_col), folds, fold), docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    blocks = profile_blocks(learn_profiles(docs.where(~out), lang_col, text_col))
    rows = rows.withColumn("found", predicted(F.col("text"), spark, next(blocks)))
    for profiles in blocks:  # the best so far against the next block's; equal scores go to the first language by code point
        both = F.array(*[F.struct((-c["score"]).alias("far"), c["lang_pred"].alias("lang")) for c in (F.col("found"), predicted(F.col("text"), spark, profiles))])
        best = F.array_min(both)
        rows = materialise(rows.withColumn("found", F.struct(best["lang"].alias("lang_pred"), (-best["far"]).alias("score"))), "identified")
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text resembles some language of ``docs``: a score of ``least`` or more.

    Null texts and texts without letters are unidentified, and so is what stays further from every profile than prose does.
    Where no document has a language, nothing can be learned and only texts without letters go.
    """
    with arrow_batches(docs.sparkSession):
        top = learn_profiles(docs, lang_col, text_col)
        if top.isEmpty():
            return docs.where(F.col(text_col).rlike(r"\p{L}"))
        gone = docs.select(*_twice_hashed(docs[text_col]), docs[text_col].alias("text"))
        for profiles in profile_blocks(top):  # what no block's languages resemble
            gone = materialise(_rejected(gone, profiles, least).distinct(), "rejected")
        gone = gone.select("first", "second")
    # Only the texts went to Python; rows lack what was rejected by two hashes of the text.
    first, second = _twice_hashed(docs[text_col])
    return docs.where(docs[text_col].isNotNull()).join(broadcast_if_small(gone), (first == gone["first"]) & (second == gone["second"]), "left_anti")


def _twice_hashed(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("first"), F.xxhash64(F.lit(1), text).alias("second")


def _rejected(texts: DataFrame, profiles: Profiles, least: float) -> DataFrame:
    """Those rows of ``texts`` (first, second, text) whose score is below ``least``."""
    shared = texts.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        predictor = Predictor(shared.value)
        for batch in batches:
            low = np.array([predictor.predict(t.as_py())[1] < least for t in batch.column(2)], bool)
            yield batch.filter(pa.array(low))

    return texts.mapInArrow(run, "first long, second long, text string")
