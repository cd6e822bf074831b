"""Every dealt operator on nulls in any column, blank and very long texts, ties, repeated rows and clashing column names."""

import public_tokenizers
import pytest

from tidemark.llm import bpe, exact_dedup, langid, lbl, lines, media, mixing, rules, simhash, urls

LONG = "Some words in a very long text, again and again.\n" * 12_000 + "x" * 90_000 + " end"
TEXTS = [None, "", " \n\t", "One line.", "One line.", "one LINE.", LONG, LONG + "!", "Ünïcödé 日本語 😀", "12 34"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, row long, of string, size string, hash string, copy long, gone string, score double, key string, media string, tokens string"


def rows():
    out = [(i, t, ["en", None, "fr"][i % 3], [None, "a", "b"][i % 3], *[None] * 12) for i, t in enumerate(TEXTS)]
    return [*out, out[3], out[6], (None, "One line.", None, None, *[None] * 12), tuple([None] * 16)]


def codec(spark):
    return bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def labels(spark):
    return spark.createDataFrame([(0, 1, None), (3, None, 0), (None, 1, 1), (6, 0, 0), (8, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "media": lambda spark, d: media.store_and_read(d),
    "langid": lambda spark, d: langid.identify(d),
    "lbl": lambda spark, d: lbl.score_texts(d),
    "rules": lambda spark, d: rules.score_quality(d, labels(spark)),
    "exact": lambda spark, d: exact_dedup.exact_duplicates(d),
    "bpe": lambda spark, d: codec(spark).encode(d),
    "urls": lambda spark, d: urls.judge(d, labels(spark), id_col="doc_id", url_col="text"),
    "lines": lambda spark, d: lines.dedup_lines(d),
    "mix": lambda spark, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = OPERATORS[name](spark, docs).collect()
    assert len(got) == len(rows())
    assert sum(r[0] is None for r in got) == 2


@pytest.mark.parametrize("keep", [langid.keep_identified, simhash.keep_one, mixing.mixed_rows])
def test_filters_keep_all_columns(spark, keep):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = keep(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= 2 * len(rows())
