import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import langid

SYLLABLES = {"xx": ["ka", "to", "mi", "ra"], "yy": ["öl", "und", "sch", "er"], "zz": ["qué", "ión", "los", "de"]}


def brute_counts(text):
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
    grams = Counter()
    for w in words:
        p = f" {w} "
        grams.update(g for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i : i + n]) != " ")
    return grams


def spelled(gram):
    return "".join(chr(c) for i in (2, 1, 0) if (c := int(gram) >> (21 * i) & (1 << 21) - 1))


def brute_profile(counts, size=langid.PROFILE):
    return sorted(counts, key=lambda g: (-counts[g], [ord(c) for c in g]))[:size]


@pytest.mark.parametrize("block", [langid.BLOCK, 7])
def test_gram_counts_and_profile_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    r = random.Random(1)
    for text in ["", "1 2, 3", "a", "A b", "日本語 x", "İx ſ"] + ["".join(r.choice("abÀ é1.\n日😀") for _ in range(r.randint(0, 80))) for _ in range(100)]:
        grams, counts = langid.gram_counts(text)
        assert {spelled(g): n for g, n in zip(grams, counts, strict=True)} == brute_counts(text)
        assert list(map(spelled, langid.profile(grams, counts, 20))) == brute_profile(brute_counts(text), 20)


def corpus(n=150):
    r = random.Random(3)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40))]
        rows.append((i, " ".join(words).capitalize() + ".", None if r.random() < 0.1 else lang, lang))
    return rows


@pytest.mark.parametrize("most", [langid.MOST_LANGUAGES, 1])
def test_predictions_equal_brute_force_and_are_right(spark, monkeypatch, most):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", most)
    rows = corpus() + [(500, None, "xx", None), (501, "", "xx", None), (502, "12 !!", "xx", None), (None, "kato mira", None, "xx"), (3, "öler und", "yy", "yy")]
    docs = spark.createDataFrame([(i, t, lang, 0.5) for i, t, lang, _ in rows], "doc_id long, text string, lang string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    out = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i, *_ in rows}
    total = {lang: Counter() for lang in SYLLABLES}
    for i, t, lang, _ in rows:
        if lang and t and not out[i]:
            total[lang].update(brute_counts(t))
    profiles = {lang: {g: k for k, g in enumerate(brute_profile(c))} for lang, c in total.items()}
    want = []
    for i, t, _, _ in rows:
        own = brute_profile(brute_counts(t or ""))
        away = {lang: sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get) if own else "und"
        want.append((i, out[i], best, 1 - away[best] / (400 * len(own)) if own else 0.0))
    key = lambda x: repr((x[0], x[2]))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-12
    truth = {i: lang for i, _, _, lang in rows}
    held = [x for x in got if x.held_out and truth[x.doc_id]]
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in held]) > 0.95


def test_no_language_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "abc", None)], "doc_id long, text string, lang string")
    assert {x.lang_pred for x in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_more_languages_than_are_sent_at_once(spark, monkeypatch):
    """A column full of dirt: as many languages as documents. Predictions and the filter are those of one block."""
    rows = [(i, t, f"{lang}-{i}", None) for i, t, lang, _ in corpus(60)] + [(900, "ηλιος νερό", None, None), (901, None, "a", None), (902, "7 8", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    one = sorted(map(tuple, langid.identify(docs).collect()))
    kept = sorted(r.doc_id for r in langid.keep_identified(docs, least=0.5).collect())
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 7)
    assert sorted(map(tuple, langid.identify(docs).collect())) == one and len({x[2] for x in one}) > 20
    assert sorted(r.doc_id for r in langid.keep_identified(docs, least=0.5).collect()) == kept == list(range(60))
